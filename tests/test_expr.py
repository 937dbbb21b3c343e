"""Column expressions against hand-computed values."""
import datetime as dt

from pyspark.sql import functions as F

from courtside.functions import expr as X
from courtside.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_shooting_formulas(spark):
    # 25/39 twos, 13/28 threes, 46 FTA, 124 points
    fgm, fga, t3m, fta, pts = 38, 67, 13, 46, 124
    assert abs(one(spark, X.efg(F.lit(fgm), F.lit(t3m), F.lit(fga))) - (38 + 6.5) / 67) < 1e-12
    assert abs(one(spark, X.ts(F.lit(pts), F.lit(fga), F.lit(fta))) - 124 / (2 * (67 + 0.44 * 46))) < 1e-12
    assert one(spark, X.ratio(F.lit(0), F.lit(0))) is None
    assert one(spark, X.per_minutes(F.lit(10), F.lit(0.0))) is None


def test_possessions_and_ratings(spark):
    p = one(spark, X.possessions(F.lit(50), F.lit(10), F.lit(12), F.lit(15)))
    assert abs(p - (50 - 10 + 12 + 0.44 * 15)) < 1e-12
    assert one(spark, X.possessions(F.lit(None).cast("int"), F.lit(1), F.lit(1), F.lit(1), strict=False)) is None
    assert one(spark, X.possessions(F.lit(40), F.lit(None).cast("int"), F.lit(None).cast("int"),
                                    F.lit(None).cast("int"), strict=False)) == 40
    assert abs(one(spark, X.rating(F.lit(78), F.lit(p))) - 78 / p * 100) < 1e-12
    assert one(spark, X.rating(F.lit(78), F.lit(0.0))) is None


def test_season_and_clock(spark):
    assert one(spark, X.season_of(F.lit(dt.date(2026, 8, 19)))) == 2025
    assert one(spark, X.season_of(F.lit(dt.date(2026, 9, 1)))) == 2026
    assert one(spark, X.season_label(F.lit(2025))) == "2025/2026"
    assert one(spark, X.clock_seconds(F.lit("05:00"))) == 300
    assert one(spark, X.clock_seconds(F.lit("abc"))) == 0
    assert one(spark, X.clock_seconds(F.lit(None).cast("string"))) == 0
    assert one(spark, X.parse_date(F.lit("31/02/2024"))) is None
    assert one(spark, X.parse_date(F.lit("04/10/2025"))) == dt.date(2025, 10, 4)


def test_zones(spark):
    # hoop at x=5 %, y=50 %: 1.0 m is rim, 6.0 m is mid, beyond 6.6 m is three
    rows = spark.createDataFrame([(5.0, 50.0), (5.0 + 100 / 28, 50.0), (5.0 + 600 / 28, 50.0),
                                  (50.0, 50.0), (95.0, 10.0)], "x double, y double")
    out = rows.select(X.shot_zone(X.shot_distance("x", "y")).alias("z")).collect()
    assert [r.z for r in out] == ["rim", "rim", "mid", "three", "mid"]


def test_play_text(spark):
    df = spark.createDataFrame([
        ("shoot", "(09:12) D. NGUBA: TIRO DE 3 ANOTADO"), ("fthrow", "(01:00) A. B: TIRO LIBRE FALLADO"),
        ("foul", "(02:00) A. B: FALTA Técnica"), ("foul", "x Descalificante"), ("foul", "plain"),
        ("subst", "Entra a pista"), ("subst", "Sale"), (None, "FALTA"), ("assist", None)], "action string, text string")
    r = df.select(X.made_from_text("action", "text").alias("m"), X.shot_value_from_text("action", "text").alias("v"),
                  X.foul_type("action", "text").alias("f"), X.sub_direction("action", "text").alias("s"),
                  X.play_label("text").alias("l")).collect()
    assert (r[0].m, r[0].v, r[0].l) == (1, 3, "D. NGUBA")
    assert (r[1].m, r[1].v) == (0, None)
    assert [x.f for x in r[2:5]] == ["technical", "disqualifying", "personal"]
    assert [x.s for x in r[5:7]] == ["in", "out"]
    assert r[7].f is None  # NULL action is not a personal foul


def test_names(spark):
    df = spark.createDataFrame([("ORTEGA IBAÑEZ, ALEJANDRO",), ("D'ANGELO PÉREZ-VILA, ZOË",), ("NOCOMMA NAME",),
                                ("",)], "n string")
    r = df.select(T.slug("n").alias("s"), T.display_name("n").alias("d")).collect()
    assert r[0].s == "ortega-ibanez-alejandro"
    assert r[0].d == "Alejandro Ortega Ibañez"
    assert r[1].d == "Zoë D'Angelo Pérez-Vila" == "D'ANGELO PÉREZ-VILA, ZOË".split(", ")[1].title() + " " + \
        "D'ANGELO PÉREZ-VILA".title()
    assert r[2].d == "Nocomma Name"
    assert r[3].s == "" and r[3].d == ""


def test_team_names(spark):
    cases = {"CB ALMENARA": "CB Almenara", "CLUB BÀSQUET L'HORTA NORD": "Club Bàsquet L'Horta Nord",
             "C.D. RIBERA ALTA": "C.D. Ribera Alta", "ATLÉTICO MONTSANT-PRIORAT": "Atlético Montsant-Priorat",
             "ALCÁZAR Y ZOCO": "Alcázar y Zoco", "THE GIL CLUB": "The Gil Club",
             "CBF TORRE D'EN BESORA": "CBF Torre D'En Besora"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r.n: r.t for r in df.select("n", T.team_display_name("n").alias("t")).collect()}
    assert got == cases


def test_group_slug(spark):
    df = spark.createDataFrame([('Liga Regular "E-A"',), ("Liga Regular Único",), ("Liga Regular",)], "n string")
    assert [r.g for r in df.select(T.group_slug("n").alias("g")).collect()] == ["E-A", "Unico", "ungrouped"]


def test_fold_is_the_whole_compatibility_decomposition(spark):
    import unicodedata

    from courtside.functions import text as T
    names = ["GARCÍA, Mª JOSÉ", "ﬁnal nº ３", "Ｆｕｌｌ", "Việt Nam", "e\u0301", "ẞ ß ł", "Ⅷ ½ ™", "plain", ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.f for r in df.select("i", T.fold("n").alias("f")).orderBy("i").collect()]
    assert got == [unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names]
    assert df.where("i = 0").select(T.slug("n").alias("s")).first().s == "garcia-ma-jose"

"""Driver tables -> bronze-shaped basketball tables.

The test tables are a generic star schema (orders, lineitem, events). These
adapters restate them as game headers, box-score lines and play-by-play,
using only integer column arithmetic, so that every number can be restated
exactly in plain SQL (see ``courtside.oracle.adapters``):

* orders    -> one game per order; competition = priority, group = status,
               date = order date, season by the September rule, two teams
* lineitem  -> one box-score line per (order, line number); odd line
               numbers are the home side; the player is (team, supplier % 12)
* events    -> one play per event, games = user ids, ordered by (ts, id);
               two consecutive plays share side and clock, so an assist can
               follow the basket it belongs to

Work grows with the tables; nothing is sampled or capped.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import ordered

# FIXED VALUES: invented club, surname and given-name lists for the
# adapters (index = team number, player slot, (slot + team) % 7).
TEAM_NAMES = [
    "CB ALMENARA", "CLUB BÀSQUET L'HORTA NORD", "UNIÓN DEPORTIVA SANT JOAN",
    "C.D. RIBERA ALTA", "BALONCESTO VILLA DE CAMPOS", "NB CASTELLÓ",
    "ATLÉTICO MONTSANT-PRIORAT", "CÁNTABRA DEL NORTE", "GRUPO ÑANDÚ MAJADAHONDA",
    "CBF TORRE D'EN BESORA", "ESCUELA OURENSE DO MIÑO", "BÁSQUET ILLES I MAR",
    "CLUB SANTA ÚRSULA", "PENYA GIRONINA", "CD ARROYO", "BALONCESTO LA SALLE TERUEL",
    "JOVENS SANT BOI-LLOBREGAT", "ALCÁZAR Y ZOCO", "NÁUTICO VIGO", "CLUB ÇAPELLA",
    "DEPORTIVO EL PINAR", "CB L'ALFÀS", "SOCIEDAD DEL VALLE", "ÁGUILAS DE ORIENTE",
]
SLOT_SURNAMES = ["GARCÍA", "NÚÑEZ", "D'ANGELO", "PÉREZ-VILA", "MARTÍN", "IBÁÑEZ",
                 "ÇELIK", "LÓPEZ", "OKAFOR", "SANZ", "MÜLLER", "RUIZ"]
TEAM_SURNAMES = ["ALONSO", "BELTRÁN", "CASTAÑO", "DÍAZ", "ESTEVE", "FERRÉ", "GIMÉNEZ",
                 "HERAS", "IRURETA", "JOVÉ", "LLORENTE", "MOYA", "NAVAS", "ORTIZ", "PUIG",
                 "QUIRÓS", "ROCA", "SÁEZ", "TORRES", "URQUIJO", "VIDAL", "YÁÑEZ", "ZAMORA",
                 "ABAD"]
GIVEN_NAMES = ["ÁLVARO", "JOSÉ MARÍA", "IÑAKI", "JORDI", "LUCAS", "ANDREU", "ZOË"]
N_TEAMS = 24
N_SLOTS = 12
PLAY_LINES = 7  # plays name the first lines of a game only (see ``line`` in :func:`plays`)


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def headers(spark: SparkSession, sf_dir: str, tasks: int | None = None,
            of: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Game header per order (bronze games, B01); ``tasks`` and ``of`` as in :func:`lines`.
    Orders are dealt as they are read, names and dates are made behind that."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    if of:
        o = of(o, "o_orderkey")
    if tasks:
        o = o.where("o_orderkey IS NOT NULL").repartition(tasks, "o_orderkey")
    game_date = F.to_date(F.col("o_orderdate"))
    home_idx = (F.col("o_custkey") % N_TEAMS).cast("int")
    away_idx = ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 23) % N_TEAMS).cast("int")
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_orderpriority").alias("competition"),
        F.col("o_orderstatus").alias("grp"),
        game_date.alias("game_date"),
        X.season_of(game_date).alias("season"),
        X.format_date(game_date).alias("date"),
        home_idx.alias("home_idx"),
        away_idx.alias("away_idx"),
        _pick(TEAM_NAMES, home_idx).alias("home_team"),
        _pick(TEAM_NAMES, away_idx).alias("away_team"),
    )


def _name(team_idx: Column, slot: Column) -> tuple[Column, Column, Column]:
    surnames = F.concat(_pick(SLOT_SURNAMES, slot), F.lit(" "), _pick(TEAM_SURNAMES, team_idx))
    given = _pick(GIVEN_NAMES, (slot + team_idx) % 7)
    return surnames, given, F.concat(surnames, F.lit(", "), given)


def lines(spark: SparkSession, sf_dir: str, tasks: int | None = None,
          of: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """One box-score line per (order, line number), first by a total order,
    joined to its header (bronze players, B02).

    With ``tasks`` both tables are dealt by order to that many tasks, once and
    as they are: the lines of a game are reduced, joined and left together, so
    what is grouped by game next needs no shuffle. For tables without a huge order.
    ``of`` keeps the rows of the games that are asked for (by the named column)."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    h = headers(spark, sf_dir, tasks, of)
    if of:
        li = of(li, "l_orderkey")
    if tasks:
        li = li.where("l_orderkey IS NOT NULL").repartition(tasks, "l_orderkey")
    # Duplicated (order, line) rows; min of a struct = first by
    # (partkey, suppkey, quantity), combined map side.
    li = (li.groupBy("l_orderkey", "l_linenumber")
            .agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("m"))
            .select("l_orderkey", "l_linenumber", "m.l_partkey", "m.l_suppkey", "m.l_quantity"))
    d = li.join(h, li.l_orderkey == h.game_id, "inner")
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    is_home = (ln % 2) == 1
    team_idx = F.when(is_home, F.col("home_idx")).otherwise(F.col("away_idx"))
    slot = (sk % N_SLOTS).cast("int")
    surnames, given, full = _name(team_idx, slot)

    def i(c: Column) -> Column:
        return c.cast("int")

    t2a, t3a, fta = i(pk % 12), i(pk % 7), i(sk % 9)
    t2m, t3m, ftm = F.least(t2a, i(sk % 7)), F.least(t3a, i(ok % 4)), F.least(fta, i(pk % 6))
    d = d.select(
        "game_id", "competition", "season", "grp", "date", "game_date", "home_team", "away_team",
        i(ln).alias("line"),
        is_home.alias("is_home"),
        team_idx.alias("team_id"),
        F.when(is_home, F.col("home_team")).otherwise(F.col("away_team")).alias("team"),
        (team_idx * N_SLOTS + slot).cast("int").alias("player_id"),
        (slot + 4).cast("int").alias("jersey"),
        full.alias("player_name"),
        surnames.alias("_surnames"), given.alias("_given"),
        i(F.col("l_quantity").cast("int") % 41).cast("double").alias("minutes"),
        t2m.alias("t2m"), t2a.alias("t2a"), t3m.alias("t3m"), t3a.alias("t3a"),
        ftm.alias("ftm"), fta.alias("fta"),
        i(ok % 4).alias("orb"), i(pk % 8).alias("drb"),
        i(sk % 8).alias("ast"), i((pk + sk) % 4).alias("stl"), i((ok + ln) % 3).alias("blk"),
        i((pk + ok) % 5).alias("tov"), i((sk + ln) % 6).alias("pf"),
        i(ok % 21 - 10).alias("plus_minus"),
    )
    d = d.withColumn("reb", F.col("orb") + F.col("drb"))
    d = d.withColumn("points", 2 * F.col("t2m") + 3 * F.col("t3m") + F.col("ftm"))
    d = d.withColumn("val", F.col("points") + F.col("reb") + F.col("ast") + F.col("stl") + F.col("blk")
                     - (F.col("t2a") - F.col("t2m")) - (F.col("t3a") - F.col("t3m"))
                     - (F.col("fta") - F.col("ftm")) - F.col("tov") - F.col("pf"))
    return d


def box_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze player rows in the shape of the document reader's output."""
    return lines(spark, sf_dir).drop("_surnames", "_given", "player_id")


def plays(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Bronze play-by-play from events (B03 shape).

    Position in a game comes from a sequence bucketed by second, so a user
    with a third of all events is numbered by many tasks.

    With ``tasks`` the events are dealt by game to that many tasks, once and as they are, and all
    steps run where they lie; ``lines`` must be dealt so too. For tables without a huge user or order.
    """
    ev = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("game_id"), "event_id", "ts", "event_type")
    whole = bool(tasks)
    if tasks:
        ev = ev.repartition(tasks, "game_id")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    ev = ordered.sequence(ev, ["game_id"], ["ts", "event_id"], second, name="num", total="n_plays", whole=whole)
    g, e, num = F.col("game_id"), F.col("event_id"), F.col("num")
    periods = F.when(g % 5 == 0, 5).otherwise(4)
    pair = F.floor((num - 1) / 2)
    t = F.floor(pair * 2 * periods * 600 / F.col("n_plays")).cast("int")
    quarter = (F.floor(t / 600) + 1).cast("int")
    left = (F.lit(600) - t % 600).cast("int")
    home_side = ((pair + g) % 2) == 0
    line = F.when(home_side, 1 + 2 * (e % 4)).otherwise(2 + 2 * (e % 3)).cast("int")
    et = F.col("event_type")
    action = (F.when(et == "click", "shoot").when(et == "purchase", "fthrow")
              .when(et == "view", "assist")
              .when(et == "error", F.when(e % 3 == 0, "lose").otherwise("foul"))
              .when(et == "signup", F.when(e % 4 == 0, "recovery").when(e % 4 == 1, "blockshot")
                    .otherwise("subst")))
    ev = ev.select(
        "game_id", "event_id", "num", quarter.alias("quarter"), X.clock_text(left).alias("time"),
        F.when(home_side, 1).otherwise(2).alias("team"), line.alias("line"), action.alias("action"))
    box = (lines if lines is not None else globals()["lines"](spark, sf_dir)).select(
        "game_id", "line", "player_id", "team_id",
        F.concat(F.substring("_given", 1, 1), F.lit(". "), F.col("_surnames")).alias("label"))
    if tasks:  # a game's lines in one list: the plays meet them by game, as they lie
        per_game = box.where(F.col("line").between(1, PLAY_LINES)).groupBy("game_id").agg(
            F.collect_list(F.struct("line", "player_id", "team_id", "label")).alias("_box"))
        d = ev.join(per_game, "game_id", "left").select(
            *ev.columns, F.explode_outer(F.filter("_box", lambda b: b["line"] == F.col("line"))).alias("_b"))
        d = d.select(*ev.columns, "_b.player_id", "_b.team_id", "_b.label")
    else:
        d = ev.join(box, ["game_id", "line"], "left")
    a = F.col("action")
    made = F.when(a == "shoot", e % 5 < 2).when(a == "fthrow", e % 4 != 0)
    value = F.when(e % 3 == 0, 3).otherwise(2)
    phrase = (F.when(a == "shoot", F.concat(F.lit("TIRO DE "), value.cast("string"), F.lit(" "),
                                          F.when(made, "ANOTADO").otherwise("FALLADO")))
              .when(a == "fthrow", F.concat(F.lit("TIRO LIBRE "), F.when(made, "ANOTADO").otherwise("FALLADO")))
              .when(a == "assist", F.lit("ASISTENCIA"))
              .when(a == "foul", F.when(e % 10 == 0, "FALTA Descalificante")
                    .when(e % 10 == 1, "FALTA Técnica").otherwise("FALTA Personal"))
              .when(a == "subst", F.when(e % 2 == 0, "Entra a pista").otherwise("Sale de pista"))
              .when(a == "lose", F.lit("PÉRDIDA")).when(a == "recovery", F.lit("RECUPERACIÓN"))
              .otherwise(F.lit("TAPÓN")))
    # Made behind the running score, so the rows are dealt without their text.
    text = F.concat(F.lit("("), F.col("time"), F.lit(") "), F.coalesce(F.col("label"), F.lit("EQUIPO")),
                    F.lit(": "), phrase)
    pts = F.when((a == "shoot") & made, value).when((a == "fthrow") & made, 1).otherwise(0)
    d = d.select("game_id", "num", "quarter", "time", "label", "team", "action",
                 "player_id", "team_id", "event_id", pts.alias("_pts"))
    d = ordered.running(
        d, ["game_id"], ["num"], ordered.bucket_of(F.col("num")),
        {"_home": F.when(F.col("team") == 1, F.col("_pts")).otherwise(0),
         "_away": F.when(F.col("team") != 1, F.col("_pts")).otherwise(0)}, how="sum", whole=whole)
    scoring = F.col("_pts") > 0
    return d.select(
        "game_id", "num", "quarter", "time", text.alias("text"), "team", "action",
        F.when(scoring, F.col("_home")).otherwise(0).cast("int").alias("scoreA"),
        F.when(scoring, F.col("_away")).otherwise(0).cast("int").alias("scoreB"),
        "player_id", "team_id", "event_id")


def shots(spark: SparkSession, sf_dir: str, pbp: DataFrame | None = None) -> DataFrame:
    """Shot chart rows (B04 shape): one per field-goal attempt of the plays,
    player by jersey, side 0 home / 1 away, x/y in percent of the court."""
    pbp = pbp if pbp is not None else plays(spark, sf_dir)
    e = F.col("event_id")
    return pbp.filter(F.col("action") == "shoot").select(
        "game_id", "quarter", "time",
        (F.col("player_id") % N_SLOTS + 4).cast("int").alias("player"),
        F.when(F.col("team") == 1, 0).otherwise(1).alias("team"),
        X.made_from_text(F.col("action"), F.col("text")).alias("made"),
        ((e * 37) % 101).cast("double").alias("x"),
        ((e * 53) % 101).cast("double").alias("y"),
    )

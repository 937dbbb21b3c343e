"""Layer build: what is dealt by game once stays so, and plays meet their own games' lines only."""
import os
import tempfile

from pyspark.sql import functions as F

from courtside.operators import clean, model
from courtside.plans import tables

SF = "/root/testdata/sf0.001"
NAMES = ("games", "players", "plays", "shots", "teams")


def _exists(path):
    return os.path.exists(path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_games_and_teams_without_a_shuffle(spark):
    root = tempfile.mkdtemp(prefix="cs-layers-")
    os.makedirs(f"{root}/players")  # left by a run that died
    with open(f"{root}/players/part-00000-x.snappy.parquet", "w") as f:
        f.write("broken")
    t = tables.build_layers(spark, SF, root, _exists)
    assert not os.path.exists(f"{root}/bronze_lines")
    for d in (model.fact_games(t.players), clean.team_box(t.players)):
        assert "Exchange" not in _plan(d)
    again = tables.build_layers(spark, SF, root, _exists)  # found, not built
    assert again.players.exceptAll(t.players).count() == 0 and again.players.count() == t.players.count() > 0


def test_same_layers_with_many_games(spark, monkeypatch):
    """Written lines, no buckets and no filter by game give the same rows."""
    few = tables.build_layers(spark, SF, tempfile.mkdtemp(prefix="cs-layers-"), _exists)
    monkeypatch.setattr(tables, "FEW_GAMES", 0)
    monkeypatch.setattr(tables, "LARGE_ORDER", 0)
    root = tempfile.mkdtemp(prefix="cs-layers-")
    many = tables.build_layers(spark, SF, root, _exists)
    assert os.path.exists(f"{root}/bronze_lines/_SUCCESS")
    for name in NAMES:
        a, b = getattr(few, name), getattr(many, name)
        assert a.schema.names == b.schema.names
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0, name
    assert few.plays.where(F.col("player_name").isNotNull()).count() > 0


def test_score_of_a_game_with_two_headers(spark, tmp_path):
    """An order that comes twice gives its plays twice, and both are in the running score."""
    from courtside.sources import driver
    for name in ("lineitem", "events", "orders"):
        d = spark.read.parquet(f"{SF}/{name}.parquet")
        (d.unionByName(d) if name == "orders" else d).write.parquet(f"{tmp_path}/{name}.parquet")
    once, twice = (driver.plays(spark, d).groupBy("game_id", "num", "player_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("scoreA") + F.col("scoreB")).alias("score")) for d in (SF, str(tmp_path)))
    both = once.withColumnsRenamed({"n": "n1", "score": "s1"}).join(twice, ["game_id", "num", "player_id"]).where("n = 2 * n1")
    assert both.count() > 0 and both.where("score > s1").count() > 0


def test_plays_dealt_by_game(spark, tmp_path):
    """Dealt by game once the plays are the same rows, also without a game, with doubled events and
    orders; only events, lines and headers are dealt, and names come without dealing plays again."""
    from courtside.sources import driver
    for name in ("lineitem", "events", "orders"):
        d = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "events":
            d = d.withColumn("user_id", F.when(F.col("event_id") % 50 > 0, F.col("user_id"))).withColumn(
                "ts", F.when(F.col("event_id") % 41 > 0, F.col("ts")))
        key = {"lineitem": "l_orderkey", "events": "event_id", "orders": "o_orderkey"}[name]
        d.unionByName(d.where(f"{key} % 3 = 0")).write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    plain = driver.plays(spark, sf)
    dealt = driver.plays(spark, sf, lines=driver.lines(spark, sf, 3), tasks=3)
    assert plain.dtypes == dealt.dtypes and plain.count() == dealt.count() > 0
    assert plain.exceptAll(dealt).count() == 0 and dealt.where("game_id IS NULL").count() > 0
    link = lambda d, whole: clean.link_assists(clean.classify_plays(d), whole=whole)
    players = clean.clean_players(driver.box_scores(spark, sf))
    named = clean.resolve_names(link(dealt, True), players, dealt=3)
    other = clean.resolve_names(link(plain, False), players)
    assert named.dtypes == other.dtypes and named.count() == other.count()
    assert named.exceptAll(other).count() == 0 and named.where("assisted_by_name IS NOT NULL").count() > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(link(driver.plays(spark, sf, lines=driver.lines(spark, sf, 3), tasks=3), True)).split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3, plan


def test_large_game_goes_by_buckets(spark, monkeypatch):
    """With a game of too many plays for one task the plays are dealt by bucket, and are the same."""
    few = tables.build_layers(spark, SF, tempfile.mkdtemp(prefix="cs-layers-"), _exists)
    monkeypatch.setattr(tables, "LARGE_GAME", 3)
    large = tables.build_layers(spark, SF, tempfile.mkdtemp(prefix="cs-layers-"), _exists)
    for name in ("plays", "shots"):
        a, b = getattr(few, name), getattr(large, name)
        assert a.dtypes == b.dtypes and a.count() == b.count() > 0 and a.exceptAll(b).count() == 0, name

"""Raw documents: write, scan with the declared schema, bronze, partition
overwrite, inventory, incremental stream."""
import os
import tempfile

from pyspark.sql import functions as F

from courtside.functions.rules import Context
from courtside.sources import lake
from courtside.streaming import incremental


def _docs(t):
    return lake.docs_from_tables(t.players, t.plays, t.shots, t.teams)


def test_roundtrip_and_bronze(spark, t):
    root = tempfile.mkdtemp(prefix="cs-raw-")
    docs = _docs(t)
    lake.write_documents(docs, root)
    # a stray file outside the pattern is ignored by the scan
    with open(os.path.join(root, "stray.json"), "w") as f:
        f.write('{"meta": {"game_id": 1}}\n')
    back = lake.read_games(spark, root)
    games = t.players.select("game_id").distinct()   # one-sided games too
    assert back.count() == games.count() > t.games.count()
    assert lake.bronze_players(back).count() == t.players.count()
    assert lake.bronze_teams(back).count() == t.teams.count()
    assert lake.bronze_plays(back).count() == t.plays.join(games, "game_id", "left_semi").count() > 0
    assert lake.bronze_shots(back).count() == t.shots.join(games, "game_id", "left_semi").count() > 0
    comp = t.games.select("competition").first()[0]
    scoped = lake.read_games(spark, root, Context(competition=comp))
    assert scoped.filter(F.col("competition") != comp).count() == 0
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "competition" in plan
    inv = lake.inventory(spark, root)
    assert inv.agg(F.sum("games")).first()[0] == games.count()


def test_many_documents_of_one_game_read_as_one(spark, t):
    """Documents cut after two rows: every reader gives the same rows."""
    cut = lake.docs_from_tables(t.players, t.plays, t.shots, t.teams, max_rows=2)
    whole = _docs(t)
    assert cut.count() > whole.count()
    for read in (lake.bronze_games, lake.bronze_players, lake.bronze_plays, lake.bronze_shots, lake.bronze_teams,
                 lake.wide_box_score, lambda d: lake.wide_lines(d, "plays")):
        a, b = read(cut), read(whole)
        assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_dynamic_overwrite_keeps_other_partitions(spark, t):
    root = tempfile.mkdtemp(prefix="cs-lake-")
    lake.write_table(t.games, root, "silver", "games")
    n = t.games.count()
    one = t.games.select("competition", "season").first()
    part = t.games.filter((F.col("competition") == one[0]) & (F.col("season") == one[1]))
    lake.write_table(part.limit(1), root, "silver", "games")
    after = lake.read_table(spark, root, "silver", "games")
    assert after.count() == n - part.count() + 1
    lake.write_table(part.limit(1), root, "silver", "games", rebuild=True)
    assert lake.read_table(spark, root, "silver", "games").count() == 1


def test_incremental_stream(spark, t):
    raw = tempfile.mkdtemp(prefix="cs-stream-raw-")
    out = tempfile.mkdtemp(prefix="cs-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="cs-stream-ckpt-")
    lake.write_documents(_docs(t), raw)
    q = incremental.load_bronze(spark, raw, out, ckpt, once=True)
    q.awaitTermination(300)
    got = incremental.read_bronze(spark, out, "players").count()
    assert got == t.players.count()
    # a second run with the same checkpoint finds nothing new
    q = incremental.load_bronze(spark, raw, out, ckpt, once=True)
    q.awaitTermination(300)
    assert incremental.read_bronze(spark, out, "players").count() == got
    # a corrected document of one game (one player less, other points) replaces its rows
    gid = t.players.groupBy("game_id").count().where("count > 2").orderBy("game_id").first().game_id
    own = t.players.where(F.col("game_id") == gid)
    keep = own.orderBy("player_name").limit(own.count() - 1).withColumn("points", F.lit(99))
    lake.docs_from_tables(keep).write.mode("append").partitionBy("competition", "year", "group").json(raw)
    incremental.load_bronze(spark, raw, out, ckpt, once=True).awaitTermination(300)
    after = incremental.read_bronze(spark, out, "players")
    assert after.count() == got - 1
    assert {r.points for r in after.where(F.col("game_id") == gid).collect()} == {99}


def test_publish_marts(spark, t):
    from courtside.plans.marts import publish_marts
    path = tempfile.mkdtemp(prefix="cs-marts-")
    publish_marts(t, path)
    from courtside.plans.marts import blocks
    assert sorted(os.listdir(path)) == sorted(blocks(t)) and len(blocks(t)) >= 13
    net = spark.read.json(f"{path}/team_assist_edges")
    assert net.count() == spark.read.json(f"{path}/assist_edges").count()   # below 300 a context here
    p = spark.read.json(f"{path}/players")
    assert p.count() == t.players.select("competition", "season", "player_name").distinct().count()
    assert "zones" in p.columns and "per_game" in p.columns


def test_export_and_schema_evolution(spark, t):
    root = tempfile.mkdtemp(prefix="cs-export-")
    lake.export_flat(t, root)
    g = spark.read.parquet(f"{root}/games")
    assert g.count() == t.games.count() and "season" in g.columns
    # additive column on a new partition; old files read with mergeSchema
    lake.write_table(t.games.limit(5), root, "serving", "g2")
    last = t.games.agg(F.max("season")).first()[0]
    newer = t.games.filter(F.col("season") == last).limit(3).withColumn("venue", F.lit("X"))
    lake.write_table(newer, root, "serving", "g2")
    merged = lake.read_table(spark, root, "serving", "g2", merge_schema=True)
    assert "venue" in merged.columns


def test_wide_lines_and_renames(spark, t):
    from courtside.plans import ingest as I
    docs = _docs(t)
    wl = lake.wide_lines(docs, "plays")
    assert {"game_id", "time", "line_time", "text", "competition"} <= set(wl.columns)
    assert wl.count() == lake.bronze_plays(docs).count()
    renamed = I.apply_renames(docs, {t.games.select("competition").first()[0]: "renamed"})
    assert renamed.filter(F.col("competition") == "renamed").count() > 0
    audit = I.audit_taxonomy(I.raw_paths(t.games), renames={})
    assert audit.filter(F.col("action") == "keep").count() == t.games.count()  # nothing named: nothing dropped


def test_declared_schema_handles_empty_sections(spark):
    """Documents with team_stats = {} and no shots only: the declared
    schema still resolves team_stats.TEAM and shot fields (an inferred
    schema would drop them)."""
    import json
    root = tempfile.mkdtemp(prefix="cs-empty-")
    d = os.path.join(root, "competition=liga/year=2019/group=ungrouped")
    os.makedirs(d)
    doc = {"meta": {"game_id": 7, "date": "05/10/2019", "home_team": "A", "away_team": "B"},
           "players_home": [{"jersey": 4, "name": "X, Y", "points": 10}], "players_away": [],
           "play_by_play": [{"num": "1", "text": None, "action": None}], "shots": [], "team_stats": {}}
    with open(os.path.join(d, "game_id=7.json"), "w") as f:
        f.write(json.dumps(doc))
    docs = lake.read_games(spark, root)
    assert lake.bronze_teams(docs).count() == 0
    assert lake.bronze_shots(docs).count() == 0
    assert lake.bronze_players(docs).count() == 1
    from courtside.operators import clean
    assert clean.classify_plays(lake.bronze_plays(docs)).count() == 0   # NULL text dropped
    g = lake.bronze_games(docs).first()
    assert (g.game_id, g.season, g.calendar_year) == (7, 2019, "2019")


def test_lake_build_scope_and_rebuild(spark, t):
    from courtside.functions.rules import Scope
    from courtside.plans import playbyplay
    from courtside.plans.lakehouse import build_lake, open_lake
    raw, root = tempfile.mkdtemp(prefix="cs-raw-"), tempfile.mkdtemp(prefix="cs-lake-")
    lake.write_documents(_docs(t), raw)
    built = build_lake(spark, raw, root)
    assert built.games.count() == t.games.count() and built.players.count() == t.players.count()
    assert built.plays.columns and {"competition", "season"} <= set(built.plays.columns) & set(built.shots.columns)
    # one season's clutch reads that season's folders only
    season = t.games.agg(F.min("season")).first()[0]
    plan = playbyplay.clutch(built.plays, built.games, Context(season=season))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"season#") and "PartitionFilters: [isnotnull(season" in plan
    # a scoped run replaces its own partitions
    comp = t.games.select("competition").orderBy("competition").first()[0]
    before = {r[0]: r[1] for r in built.players.groupBy("competition").count().collect()}
    docs = lake.read_games(spark, raw, Scope((comp,), (season,)))
    assert docs.select("competition", "year").distinct().collect() == [(comp, season)]
    build_lake(spark, raw, root, Scope((comp,), (season,)))
    after = {r[0]: r[1] for r in open_lake(spark, root).players.groupBy("competition").count().collect()}
    assert after == before
    build_lake(spark, raw, root, Scope((comp,), (season,)), rebuild=True)
    assert [r[0] for r in open_lake(spark, root).players.select("competition").distinct().collect()] == [comp]
    serving = spark.read.parquet(f"{root}/serving/plays")
    assert serving.where("team IS NULL OR scoreA IS NULL OR scoreB IS NULL").count() == 0
    assert dict(serving.dtypes)["quarter"] == "smallint"


def test_serving_null_rules(spark):
    rows = [(7, "c", 2000, None, "t", "x", None, None, None, None, None, None, None, None, None, None, None, None, None)]
    from courtside.sources.schema import SERVING
    columns = SERVING["plays"][0]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in columns.items()))
    r = lake.to_serving(df, "plays").first()
    assert (r.quarter, r.team, r.scoreA, r.scoreB, r.player_id) == (None, 0, 0, 0, None)


def test_published_leaders_beyond_the_first_page(t):
    from dataclasses import replace

    from courtside.plans.marts import blocks
    one = t.players.limit(1).crossJoin(t.players.sparkSession.range(60).withColumnRenamed("id", "n"))
    many = one.withColumns({"player_name": F.concat(F.lit("PLAYER "), F.col("n").cast("string")), "minutes": F.lit(30.0)})
    games = t.players.sparkSession.range(10).select(F.col("id").alias("game_id"))
    many = many.drop("game_id", "n").crossJoin(games).select(*t.players.columns)
    b = blocks(replace(t, players=many))
    assert b["leaders_total"].first().leaders_total == 60 and b["leaders"].count() == 60


def test_parquet_tables_are_packed(spark, tmp_path):
    """Layer tables are written with zstd unless the caller names another codec."""
    import pyarrow.parquet as pq
    df = spark.range(50).selectExpr("id", "'a' AS competition", "1 AS season")
    for name, options, codec in (("x", None, "ZSTD"), ("y", {"compression": "snappy"}, "SNAPPY")):
        lake.write_table(df, str(tmp_path), "silver", name, sort_by=("id",), options=options)
        found = list(tmp_path.joinpath("silver", name).rglob("*.parquet"))
        assert found and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == codec for f in found)
        assert lake.read_table(spark, str(tmp_path), "silver", name).count() == 50


def test_only_games_delivered_again_are_joined(spark, tmp_path):
    out = str(tmp_path)
    for batch, games in enumerate([[1, 2, None], [3, 2], [4]]):
        spark.createDataFrame([(g,) for g in games], "game_id long").write.parquet(f"{out}/games/batch={batch}")
        spark.createDataFrame([(g, f"{g}-{batch}") for g in games], "game_id long, name string").write.parquet(f"{out}/players/batch={batch}")
    got = incremental.read_bronze(spark, out, "players")
    assert got.columns == ["game_id", "name", "batch"]
    assert sorted(r.name for r in got.collect()) == ["1-0", "2-1", "3-1", "4-2"]
    once = f"{out}/once"
    spark.createDataFrame([(1,), (2,)], "game_id long").write.parquet(f"{once}/games/batch=0")
    spark.createDataFrame([(1, "a"), (2, "b")], "game_id long, name string").write.parquet(f"{once}/players/batch=0")
    got = incremental.read_bronze(spark, once, "players")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 2

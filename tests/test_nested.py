"""Whole answers as nested rows: bounded lists, all rows, in order."""
import tempfile

import pytest
from pyspark.sql import functions as F

from courtside.functions.rules import Context
from courtside.plans import api, nested, sheets


def test_parts_are_bounded_and_whole(spark):
    keys = ["competition", "season", "player_name"]
    parents = spark.createDataFrame([("c", 1, "hot", 7), ("c", 1, "calm", 8), (None, 1, "odd", 9)], "competition string, season int, player_name string, n int")
    rows = spark.range(1003).select(F.lit("c").alias("competition"), F.lit(1).alias("season"), F.lit("hot").alias("player_name"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, 1, "odd", 5), ("c", 1, "nobody", 6)], "competition string, season int, player_name string, id long"))
    few = rows.where("id < 150 AND player_name = 'hot'").withColumnRenamed("id", "other")
    child = lambda d, c: nested.Child(d, (F.col(c), F.lit(0), F.lit("")), F.floor(F.col(c) / 10))
    out = nested.nest(parents, keys, {"rows": child(rows, "id"), "few": child(few, "other")}, part_rows=100).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.part):
        by.setdefault(r.player_name, []).append(r)
    hot = by["hot"]
    assert [r.part for r in hot] == list(range(11)) and {r.parts for r in hot} == {11} and {r.n for r in hot} == {7}
    assert [x.id for r in hot for x in r["rows"]] == list(range(1003)) and max(len(r["rows"]) for r in hot) == 100
    assert [x.other for r in hot for x in r["few"]] == list(range(150))
    assert [(r.part, r.parts, r["rows"], r["few"]) for r in by["calm"]] == [(0, 1, [], [])]
    assert [x.id for r in by["odd"] for x in r["rows"]] == [5] and set(by) == {"hot", "calm", "odd"}


def test_player_answers_hold_all_rows(spark, t):
    d = nested.player_answers(t, part_rows=3).cache()
    assert d.agg(F.max(F.size("game_log")), F.max(F.size("shots"))).first()[0] <= 3
    log = d.select(*nested.PLAYER, F.explode("game_log").alias("x")).select(*nested.PLAYER, "x.*")
    want = sheets.game_log(t.players, t.games).select(*log.columns)
    assert log.exceptAll(want).count() == 0 and want.exceptAll(log).count() == 0
    shots = d.select(*nested.PLAYER, F.explode("shots").alias("x")).select(*nested.PLAYER, "x.*")
    assert shots.count() == sheets.player_shots(t.players, t.shots).count()
    assert d.where("part = 0").count() == t.players.select(*nested.PLAYER).distinct().count()


def test_snapshot_and_manifest(spark, t):
    path = tempfile.mkdtemp(prefix="cs-snapshot-")
    manifest = nested.publish_snapshot(t, path, part_rows=5)
    rows = manifest.groupBy("answer").agg(F.sum("rows").alias("n"), F.max("longest").alias("longest")).collect()
    got = {r.answer: (r.n, r.longest) for r in rows}
    for name, make in nested.ANSWERS.items():
        d = make(t, part_rows=5)
        back = spark.read.schema(d.schema).json(f"{path}/{name}")
        assert got[name][0] == back.count() and got[name][1] <= 5
        log = lambda x: x.select(F.explode("game_log").alias("g")).select("g.game_id", "g.date")
        assert log(back).exceptAll(log(d)).count() == 0 and log(d).count() == log(back).count()


def test_unknown_slugs_are_errors(t):
    first = t.players.select("competition", "season", "player_name").orderBy("player_name").first()
    ctx = Context(competition=first.competition, season=first.season)
    with pytest.raises(api.NotFound):
        api.player_sheet(t, ctx, "no-such-player")
    with pytest.raises(api.NotFound):
        api.team_answer(t, ctx, "no-such-team")
    slug = sheets.player_lookup(t.players.where(F.col("player_name") == first.player_name)).first().slug
    assert {r.player_name for r in api.player_answer(t, ctx, slug).collect()} == {first.player_name}
    other = t.players.where((F.col("competition") != first.competition) | (F.col("season") != first.season))
    name = other.join(t.players.where((F.col("competition") == first.competition) & (F.col("season") == first.season))
                      .select("player_name"), "player_name", "left_anti").select("player_name").first()
    if name is not None:  # known, but not in this context
        slug = sheets.player_lookup(t.players.where(F.col("player_name") == name[0])).first().slug
        with pytest.raises(api.NotFound):
            api.player_sheet(t, ctx, slug)


def test_games_are_dealt_to_players(t):
    """The logs of player answers: players are not dealt to meet their games."""
    answers = nested.player_answers(t)
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert t.dealt and f"RepartitionByExpression [game_id" in plan
    assert answers.select(*nested.PLAYER, F.explode("game_log.game_id")).count() == t.players.join(t.games, "game_id").count()

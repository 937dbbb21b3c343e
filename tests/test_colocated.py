"""Joins on a game over bucketed tables: same answers, no exchange below them, hot games in pieces."""
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from courtside.plans import playbyplay as P
from courtside.plans import sheets as S
from courtside.plans.colocated import open_colocated, write_colocated
from courtside.plans.context import PIECE


def _root():
    return tempfile.mkdtemp(prefix="cs-colocated-") + "/tables"


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def hot(spark, t):
    """A third of all plays and players are of one game."""
    one = t.games.agg(F.min("game_id")).first()[0]
    moved = lambda d, k: d.withColumn("game_id", F.when(F.xxhash64(*k) % 3 == 0, F.lit(one)).otherwise(F.col("game_id")))
    root = _root()
    moved(t.plays, ["game_id", "num"]).distinct().write.parquet(f"{root}/plays")
    moved(t.players, ["game_id", "player_name"]).distinct().write.parquet(f"{root}/players")
    return spark.read.parquet(f"{root}/plays"), spark.read.parquet(f"{root}/players"), t.games, one


@pytest.fixture(scope="module")
def tables(hot):
    plays, players, games, _ = hot
    return write_colocated(plays, players, games, _root(), piece_rows=50, bucket_rows=400)


def test_same_answers(hot, tables):
    plays, players, games, _ = hot
    assert _rows(P.assist_edges(tables.plays, tables.games)) == _rows(P.assist_edges(plays, games))
    assert _rows(P.player_fouls(tables.plays, tables.games, tables.players)) == _rows(P.player_fouls(plays, games, players))
    assert _rows(S.game_log(tables.players, tables.games)) == _rows(S.game_log(players, games))


def test_no_exchange_below_the_joins(spark, tables):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (P.with_games(tables.plays, tables.games), S.game_log(tables.players, tables.games),
                   P.assist_edges(tables.plays, tables.games), P.foul_games(tables.plays, tables.games)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Bucketed: true" in plan
            below = plan[plan.index("SortMergeJoin"):]
            assert "Exchange" not in below, below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_hot_game_is_spread(hot, tables):
    plays, _, _, one = hot
    n = plays.where(F.col("game_id") == one).count()
    assert n * 3 >= plays.count() and tables.buckets > 4
    per = [r["count"] for r in tables.plays.where(F.col("game_id") == one).groupBy(PIECE).count().collect()]
    assert sum(per) == n and max(per) <= 2 * 50
    files = tables.plays.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert files < plays.count() / 3  # a bucket holds less than the hot game


def test_opened_again(spark, tables):
    name = re.search(r"courtside_\w+_plays", tables.plays._jdf.queryExecution().analyzed().toString()).group()
    root = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()[1].rsplit("/", 1)[0]
    before = tables.plays.count()
    for n in ("plays", "players", "games"):
        spark.sql(f"DROP TABLE {name[:-len('plays')]}{n}")
    again = open_colocated(spark, root.removeprefix("file:"))
    assert again.plays.count() == before and again.buckets == tables.buckets


def test_games_by_piece_need_rows_by_piece(hot, tables):
    with pytest.raises(ValueError):
        P.with_games(hot[0], tables.games)


def test_empty_tables(spark, hot):
    plays, players, games, _ = hot
    c = write_colocated(plays.limit(0), players.limit(0), games.limit(0), _root())
    assert c.buckets == 1 and P.assist_edges(c.plays, c.games).count() == 0

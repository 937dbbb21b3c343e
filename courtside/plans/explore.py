"""Exploration questions over a wide box score.

These follow the notebook's conventions: percentages with no attempts are
0 (C8), games = row count, efficiency = mean of the per-game rating.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Line, aggregates, measures

SUMMED = measures("sum", ["ast", "blk", "fta", "ftm", "minutes", "points", "reb", "stl", "t2a", "t2m", "t3a", "t3m",
                          "tov"], str)
# FIXED VALUES: names of the exploration columns.
SHARES = {"fg_percentage": "field", "ft_percentage": "free", "three_p_percentage": "three"}
PER_GAME = {"apg": "ast", "bpg": "blk", "ppg": "points", "rpg": "reb", "spg": "stl"}


def _explored(players: DataFrame, keys: list[str], more: list = ()) -> DataFrame:
    """Summed counters per key, field goals, and shares that are 0 (not
    NULL) without attempts."""
    line = Line(made_of=True)
    d = players.groupBy(*keys).agg(*aggregates(SUMMED), *more)
    return d.withColumns({"fg_made": line["fgm"], "fg_attempted": line["fga"],
                          **{n: F.coalesce(line.rate(k), F.lit(0.0)) for n, k in SHARES.items()}})


def team_day(players: DataFrame) -> DataFrame:
    """Team x date; pace = minutes / 40, efficiency = points per pace
    (a pace of 0 counts as 1)."""
    pace = F.col("minutes") / 40
    return _explored(players, ["team", "date"]).withColumns({
        "pace": pace, "efficiency": F.col("points") / F.coalesce(F.nullif(pace, F.lit(0.0)), F.when(pace == 0, 1.0))})


def career(players: DataFrame) -> DataFrame:
    """Player totals over every row, mean rating, per-game rates."""
    d = _explored(players, ["player_name"], [F.count("game_id").alias("games"), F.avg("val").alias("efficiency")])
    return d.withColumns({n: F.col(c) / F.col("games") for n, c in PER_GAME.items()})


def top_scorers(players: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` career scorers with the most points (name breaks ties)."""
    return (career(players).orderBy(F.desc("points"), F.asc("player_name")).limit(n)
            .select("player_name", "games", "points", "ppg", "fg_percentage",
                    "three_p_percentage", "ft_percentage"))


def player_count(players: DataFrame) -> DataFrame:
    """Number of distinct players."""
    return players.agg(F.count_distinct("player_name").alias("players"))

"""Scope of a question (competition, season, group).

Every question answers for all contexts at once (grouped by competition
and season) unless a context narrows it; the filters sit on partition-like
columns so they reach the scan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.rules import Context
from ..sources.lake import narrow

CTX = ["competition", "season"]
PIECE = "game_piece"  # part of a hot game in bucketed tables (see colocated)


def game_key(rows: DataFrame, games: DataFrame) -> list[str]:
    """Columns that join rows to their game: of bucketed tables also the piece, which
    makes the join follow their buckets."""
    if PIECE not in games.columns:
        return ["game_id"]
    if PIECE not in rows.columns:
        raise ValueError("games by piece only join rows by piece")
    return ["game_id", PIECE]


def in_context(df: DataFrame, ctx: Context | None) -> DataFrame:
    """Optional filters, each only when given; on partition columns they
    prune folders."""
    return narrow(df, ctx)


def resolve_context(games: DataFrame, ctx: Context | None = None) -> DataFrame:
    """One row (competition, season): the season with most games
    (latest on ties), then the competition with most games in it (name on
    ties). Given values win. An empty result means "no data"."""
    ctx = ctx or Context()
    g = games
    if ctx.season is not None:
        season = g.filter(F.col("season") == int(ctx.season)).select("season").distinct()
    else:
        season = (g.groupBy("season").agg(F.count(F.lit(1)).alias("n"))
                  .orderBy(F.desc("n"), F.desc("season")).limit(1).select("season"))
    g = g.join(season, "season", "left_semi")
    if ctx.competition is not None:
        comp = g.filter(F.col("competition") == ctx.competition).select("competition", "season").distinct()
    else:
        comp = (g.groupBy("competition", "season").agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("n"), "competition").limit(1).select("competition", "season"))
    return comp


def describe_context(games: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Per context: games, distinct dates, sorted groups, label."""
    d = in_context(games, ctx)
    groups = d.select(*CTX, "grp").distinct()
    sets = groups.groupBy(*CTX).agg(F.sort_array(F.collect_list("grp")).alias("groups"))
    counts = d.groupBy(*CTX).agg(F.count(F.lit(1)).alias("games"),
                                 F.count_distinct("game_date").alias("match_days"))
    out = counts.join(sets, CTX)
    label = (F.when(F.size("groups") == 1, F.get(F.col("groups"), 0))
             .otherwise(F.concat(F.size("groups").cast("string"), F.lit(" groups"))))
    if ctx is not None and ctx.group is not None:
        label = F.lit(ctx.group)
    return out.select(*CTX, X.season_label(F.col("season")).alias("season_label"),
                      "games", "match_days", "groups", label.alias("group_label"))


def catalogue(games: DataFrame) -> DataFrame:
    """Competition x season -> sorted groups and games, season desc."""
    groups = games.select(*CTX, "grp").distinct()
    sets = groups.groupBy(*CTX).agg(F.sort_array(F.collect_list("grp")).alias("groups"))
    counts = games.groupBy(*CTX).agg(F.count(F.lit(1)).alias("games"))
    return (counts.join(sets, CTX)
            .select(*CTX, X.season_label(F.col("season")).alias("season_label"), "groups", "games"))


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0,
         partition: list[str] | None = None, max_limit: int = 500) -> DataFrame:
    """Stable page of a sorted answer; position kept as a column.

    ``order`` must end in a unique key. With ``partition`` the page is
    taken in every context at once.
    """
    limit = max(1, min(int(limit), max_limit))
    offset = max(0, int(offset))
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    ranked = df.withColumn("position", F.row_number().over(w))
    return ranked.filter((F.col("position") > offset) & (F.col("position") <= offset + limit))

"""League-level questions: standings, games, dashboard, leaders."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.metrics import Line, aggregates, measures
from ..functions.rules import LIMITS, Context
from ..operators.model import latest
from .context import CTX, in_context, page


def both_sides(games: DataFrame) -> DataFrame:
    """One row per team and game from one scan (no UNION of two scans)."""
    sides = F.array(
        F.struct(F.col("home_team").alias("team"), F.col("home_score").alias("pf"),
                 F.col("away_score").alias("pa"), F.lit(True).alias("is_home")),
        F.struct(F.col("away_team").alias("team"), F.col("away_score").alias("pf"),
                 F.col("home_score").alias("pa"), F.lit(False).alias("is_home")),
    )
    return games.select("game_id", *CTX, "grp", "game_date", F.inline(sides))


def standings(games: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Games, wins, losses (a tie is a loss for both, C11), points
    for/against, difference, rank by (wins, diff) with the name last."""
    rows = both_sides(in_context(games, ctx))
    t = rows.groupBy(*CTX, "team").agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(F.col("pf") > F.col("pa")).alias("wins"),
        F.sum("pf").alias("points_for"),
        F.sum("pa").alias("points_against"),
    )
    t = t.withColumns({"losses": F.col("games") - F.col("wins"),
                       "diff": F.col("points_for") - F.col("points_against")})
    w = Window.partitionBy(*CTX).orderBy(F.desc("wins"), F.desc("diff"), F.asc("team"))
    return t.select(*CTX, F.row_number().over(w).alias("rank"), "team",
                    T.slug(F.col("team")).alias("team_key"),
                    "games", "wins", "losses", "points_for", "points_against", "diff")


def game_list(games: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Every game, newest first, with its match-day number
    (distinct dates, latest = 1) inside the context."""
    d = in_context(games, ctx)
    dates = d.select(*CTX, "game_date").distinct()
    w = Window.partitionBy(*CTX).orderBy(F.desc("game_date"))
    days = dates.withColumn("match_day", F.dense_rank().over(w))
    return d.join(days, CTX + ["game_date"]).select(
        *CTX, "grp", "game_id", "date", "match_day", "home_team", "away_team",
        "home_score", "away_score")


def recent_games(games: DataFrame, ctx: Context | None = None, n: int = 8) -> DataFrame:
    """Latest ``n`` games per context (date desc, id desc)."""
    d = in_context(games, ctx).select(*CTX, "game_id", "date", "game_date", "home_team",
                                      "away_team", "home_score", "away_score")
    return page(d, [F.desc("game_date"), F.desc("game_id")], limit=n, partition=CTX,
                max_limit=max(n, 1))


def summary(games: DataFrame, players: DataFrame, shots: DataFrame,
            ctx: Context | None = None) -> DataFrame:
    """Games, teams, players, shots per context.

    Shots belong to a context through their game (semi join); the four
    counts are joined on the context key instead of a cross join.
    """
    g = in_context(games, ctx)
    p = in_context(players, ctx)
    n_games = g.groupBy(*CTX).agg(F.count(F.lit(1)).alias("games"))
    n_pl = p.groupBy(*CTX).agg(F.count_distinct("team").alias("teams"),
                               F.count_distinct("player_name").alias("players"))
    game_ctx = g.select("game_id", *CTX)
    n_shots = (shots.select("game_id").join(game_ctx, "game_id")
               .groupBy(*CTX).agg(F.count(F.lit(1)).alias("shots")))
    return (n_games.join(n_pl, CTX, "left").join(n_shots, CTX, "left")
            .select(*CTX, "games", F.coalesce("teams", F.lit(0)).alias("teams"),
                    F.coalesce("players", F.lit(0)).alias("players"),
                    F.coalesce("shots", F.lit(0)).alias("shots")))


# FIXED VALUES: names of the averages that follow no rule (counter -> name).
AVERAGE_NAMES = {"minutes": "min", "points": "pts", "tov": "to"}
PLAYER_LINE = {
    **measures("mean", ["ast", "blk", "minutes", "plus_minus", "points", "reb", "stl", "tov", "val"],
               lambda c: f"avg_{AVERAGE_NAMES.get(c, c)}"),
    **measures("sum", ["fta", "ftm", "t2a", "t2m", "t3a", "t3m"], "sum_{}".format),
    "total_points": ("sum", "points"),
}


def player_lines(players: DataFrame, ctx: Context | None = None,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """A11/A15 shared body: per player averages and shooting sums."""
    keys = [*CTX, *by, "player_name"]
    last = [c for c in ("team", "grp", "jersey") if c not in by]
    d = in_context(players, ctx).groupBy(*keys).agg(
        latest(*last).alias("_last"), F.count(F.lit(1)).alias("games"), *aggregates(PLAYER_LINE))
    line = Line(lambda c: "total_points" if c == "points" else f"sum_{c}", made_of=True)
    return d.select(*keys, T.slug(F.col("player_name")).alias("slug"), *[F.col(f"_last.{c}").alias(c) for c in last],
                    "games", *PLAYER_LINE, *[c.alias(n) for n, c in line.rates("sheet").items()])


def eligible(players: DataFrame, ctx: Context | None = None,
             min_games: int = LIMITS.leader_games, min_minutes: int = LIMITS.leader_minutes) -> DataFrame:
    """Players over the game and minute thresholds (the pool)."""
    d = player_lines(players, ctx)
    return d.filter((F.col("games") >= min_games) & (F.col("avg_min") >= min_minutes))


def leaders(players: DataFrame, ctx: Context | None = None, limit: int = 50, offset: int = 0,
            min_games: int = LIMITS.leader_games, min_minutes: int = LIMITS.leader_minutes) -> DataFrame:
    """Leaders page per context, by average rating (name last)."""
    pool = eligible(players, ctx, min_games, min_minutes)
    return page(pool, [F.desc("avg_val"), F.asc("player_name")], limit, offset, partition=CTX)


def leaders_total(players: DataFrame, ctx: Context | None = None,
                  min_games: int = LIMITS.leader_games, min_minutes: int = LIMITS.leader_minutes) -> DataFrame:
    """Number of eligible leaders per context."""
    return (eligible(players, ctx, min_games, min_minutes)
            .groupBy(*CTX).agg(F.count(F.lit(1)).alias("leaders_total")))

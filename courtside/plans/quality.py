"""Data-quality rules (Q01-Q13) as one operator: rows ``(rule, violations)``.

Row rules over one table share a single aggregate pass (one ``count_if`` per
rule); rules on groups are one count each. Ratios are recomputed from raw
counters by another route than the one that made them, and a missing value
where one belongs is a violation. Nothing is collected.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .context import CTX
from .league import both_sides, game_list, leaders, standings
from .playbyplay import foul_games, player_fouls
from .sheets import zones

CONTRACT = {"players": ["game_id", "player_name", "team", "is_home", "minutes", "points", "t2m", "t2a",
                        "t3m", "t3a", "ftm", "fta", "reb", "ast", "stl", "blk", "tov", "pf", "val"],
            "games": ["game_id", "competition", "season", "home_team", "away_team", "home_score", "away_score"]}


def _rules(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Several row rules over one table in a single pass; a rule that is
    neither true nor false counts as a violation."""
    agg = df.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(f"r{i}") for i, bad in enumerate(named.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
                     for i, name in enumerate(named)])
    return agg.select(F.inline(rows))


def _count(name: str, df: DataFrame) -> DataFrame:
    return _rules(df, {name: F.lit(True)})


def _missing(columns: list[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def _differs(a: Column, b: Column) -> Column:
    return ~F.round(a, 9).eqNullSafe(F.round(b, 9))


def _counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _unequal(pairs: dict[str, tuple[list[str], DataFrame, DataFrame]]) -> DataFrame:
    """Per rule the keys whose two counts (last columns of the frames) differ,
    or that only one side has. All rules share one aggregate: both sides of
    each are stacked and meet on (rule, key)."""
    sides = []
    for name, (keys, *frames) in pairs.items():
        for side, df in zip("ab", frames):
            key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
            sides.append(df.select(F.lit(name).alias("rule"), key.alias("key"), *[
                (F.col(df.columns[-1]) if side == s else F.lit(None)).cast("long").alias(s) for s in "ab"]))
    met = reduce(DataFrame.unionByName, sides).groupBy("rule", "key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    # A rule whose tables are empty has no violations.
    names = F.explode(F.array(*[F.lit(n) for n in pairs]))
    every = met.sparkSession.range(1).select(names.alias("rule"))
    bad = met.groupBy("rule").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n"))
    return every.join(bad, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("violations"))


def _player_rules() -> dict[str, Column]:
    tries = F.col("t2a") + F.col("t3a")
    points = 2 * F.col("t2m") + 3 * F.col("t3m") + F.col("ftm")
    alone = lambda pct, n: F.col(pct).isNull() != (F.col(n) == 0)
    return {
        "q01_team_missing_or_wrong_side":
            ~F.col("team").eqNullSafe(F.when(F.col("is_home"), F.col("home_team")).otherwise(F.col("away_team")))
            | F.col("team").isNull(),
        "q03_efg_formula": _differs(F.col("effective_fg_pct"),
                                    F.when(tries > 0, (F.col("t2m") + F.lit(1.5) * F.col("t3m")) / tries)),
        "q03_ts_formula": _differs(F.col("true_shooting_pct"),
                                   F.when(tries + F.col("fta") > 0, points / (2 * tries + F.lit(0.88) * F.col("fta")))),
        "q03_pct_without_attempts": alone("two_point_pct", "t2a") | alone("three_point_pct", "t3a") | alone("free_throw_pct", "fta"),
        "q11_makes_over_attempts":
            (F.col("t2m") > F.col("t2a")) | (F.col("t3m") > F.col("t3a")) | (F.col("ftm") > F.col("fta")),
        "_required": _missing(CONTRACT["players"]),
    }


def check(t) -> DataFrame:
    p, g, pl, s, tm = t.players, t.games, t.plays, t.shots, t.teams
    table = standings(g)
    box = tm.groupBy("game_id").agg(F.sum(F.when(F.col("is_home"), F.col("points"))).alias("h"),
                                    F.sum(F.when(~F.col("is_home"), F.col("points"))).alias("a"))
    canvas = X.half_court("x", "y")
    lost = both_sides(g).groupBy(*CTX, "team").agg(F.count_if(F.col("pf") <= F.col("pa")).alias("not_won"))
    here = p.join(g.select(*CTX).distinct(), CTX, "left_semi")
    # Q07: shots in a zone, through the zone answer, and all shots of a shirt, counted before they meet the player.
    in_zone = zones(p, s).where("zone IS NOT NULL").groupBy(*CTX, "player_name").agg(F.sum("att").alias("z"))
    shirt = ["game_id", "jersey", "side"]
    shot = _counted(s.select("game_id", F.col("player").alias("jersey"), F.col("team").alias("side")), shirt, "n")
    wearer = p.select(*CTX, "player_name", "game_id", "jersey", X.shot_side("is_home").alias("side")).distinct()
    by_shirt = wearer.join(shot, shirt).groupBy(*CTX, "player_name").agg(F.sum("n").alias("n"))
    pages = leaders(p, limit=10).unionByName(leaders(p, limit=10, offset=10))
    fouls = player_fouls(pl, g, p)
    counted = foul_games(pl, g, every=True).groupBy(*CTX, "player_name").agg(F.sum("fouls").alias("fouls"))
    days = game_list(g)
    # Q09: different games with and without the group filter; a game listed in two groups shows here.
    in_group = g.groupBy(*CTX, "grp").agg(F.count_distinct("game_id").alias("n"))
    whole = g.groupBy(*CTX).agg(F.count_distinct("game_id").alias("whole"), F.count_distinct("grp").alias("groups"))
    rules = [
        _rules(p, _player_rules()),
        _rules(g, {"_required": _missing(CONTRACT["games"])}),
        _count("q04_game_in_two_contexts",
               p.groupBy("game_id").agg(F.count_distinct(*CTX).alias("n")).filter(F.col("n") > 1)),
        _count("q05_score_vs_team_box",
               g.join(box, "game_id", "left").filter(
                   ~F.col("home_score").eqNullSafe(F.col("h")) | ~F.col("away_score").eqNullSafe(F.col("a")))),
        _rules(s, {
            "q06_zone_distance_points":
                ~F.col("zone").isin("rim", "mid", "three") | (F.col("shot_distance_m") > 28)
                | (F.col("made").eqNullSafe(F.lit(1)) & F.col("is_three") & (F.col("shot_points") != 3)),
            "q12_shot_outside_canvas":
                (canvas["cx"] < -1e-6) | (canvas["cx"] > 1500 + 1e-6)
                | (canvas["cy"] < -1e-6) | (canvas["cy"] > 1400 + 1e-6),
        }),
        _unequal({
            "q07_zone_attempts_vs_shots": ([*CTX, "player_name"], in_zone, by_shirt),
            "q08_games_vs_wins_losses": ([*CTX, "team"], table.select(*CTX, "team", F.col("games") - F.col("wins")), lost),
            "q08_standing_teams_vs_summary": (CTX, _counted(table, CTX, "st"),
                                              here.groupBy(*CTX).agg(F.count_distinct("team").alias("teams"))),
            "q12_match_days_lose_games": (CTX, _counted(days, CTX, "n"), _counted(g, CTX, "m")),
        }),
        _count("q09_context_mixed",
               p.select("game_id", *[F.col(c).alias(f"p_{c}") for c in CTX]).distinct()
               .join(g.select("game_id", *CTX), "game_id")
               .filter((F.col("p_competition") != F.col("competition")) | (F.col("p_season") != F.col("season")))),
        _count("q09_group_does_not_shrink",
               in_group.join(whole, CTX).filter((F.col("groups") > 1) & (F.col("n") >= F.col("whole")))),
        _count("q10_pages_overlap", _counted(pages, [*CTX, "player_name"], "n").filter("n > 1")),
        _rules(pl, {
            "q11_self_assist": F.coalesce(F.col("assisted_by_name") == F.col("player_name"), F.lit(False)),
            "q13_unresolved_player_names": F.col("player_id").isNotNull() & F.col("player_name").isNull(),
        }),
        _count("q11_foul_types_and_games",
               fouls.join(counted, [*CTX, "player_name"], "left").filter(
                   ~F.col("total_fouls").eqNullSafe(F.col("fouls")) | (F.col("fouled_out_games") > F.col("games")))),
        _count("q12_match_day_mixes_dates",
               days.groupBy(*CTX, "match_day").agg(F.count_distinct("date").alias("n")).filter("n > 1")),
    ]
    every = reduce(DataFrame.unionByName, rules)
    # The two tables' required values are one rule.
    return every.withColumn("rule", F.when(F.col("rule") == "_required", "q02_required_values").otherwise(F.col("rule"))).groupBy(
        "rule").agg(F.sum("violations").alias("violations"))

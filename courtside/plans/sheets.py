"""Player and team sheets (A13-A17, J06-J08, J12-J14), for all keys at once."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import text as T
from ..functions.metrics import Line, aggregates, measures
from ..functions.rules import Context
from ..operators.model import latest
from .context import CTX, game_key, in_context
from .league import player_lines, standings


PER_GAME = ("minutes", "points", "reb", "ast", "stl", "blk", "tov", "val")
BESTS = ("points", "reb", "ast", "val")
SHEET = {
    **measures("sum", [*PER_GAME, "pf", "fta", "ftm", "t2a", "t2m", "t3a", "t3m"], "sum_{}".format),
    **measures("best", BESTS, "best_{}".format),
    "avg_plus_minus": ("mean", "plus_minus"),
}


def player_sheet(players: DataFrame, ctx: Context | None = None, slug: str | None = None) -> DataFrame:
    """Totals, per game, shooting, per 36, bests; one row per player."""
    d = in_context(players, ctx)
    if slug is not None:
        d = d.filter(T.slug(F.col("player_name")) == slug)
    d = d.groupBy(*CTX, "player_name").agg(
        latest("team", "grp", "jersey").alias("_last"), F.count(F.lit(1)).alias("games"), *aggregates(SHEET))
    line = Line("sum_{}".format, made_of=True)
    return d.select(
        *CTX, "player_name", T.slug(F.col("player_name")).alias("slug"),
        *[F.col(f"_last.{c}").alias(c) for c in ("team", "grp", "jersey")], "games", *SHEET,
        *[(line[c] / F.col("games")).alias(f"per_game_{c}") for c in PER_GAME],
        *[c.alias(n) for n, c in line.rates("sheet").items()],
        *[line.per(c, 36).alias(f"per36_{c}") for c in ("points", "reb", "ast")])


def game_log(players: DataFrame, games: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Each player's games with rival, score, won flag, and
    whether the game equals the player's best scoring game.

    A player's games in a context are bounded by the season's length, so the
    best is a window over them instead of a second aggregate and a join.
    """
    key = game_key(players, games)
    p = in_context(players, ctx).select(*CTX, "player_name", *key, "is_home", "minutes",
                                        "points", "reb", "ast", "val")
    g = games.select(*key, "date", "game_date", "home_team", "away_team", "home_score", "away_score")
    d = p.join(g, key)
    best = F.max("points").over(Window.partitionBy(*CTX, "player_name"))
    home = F.col("is_home")
    return d.select(
        *CTX, "player_name", "game_id", "date", "is_home",
        F.when(home, F.col("away_team")).otherwise(F.col("home_team")).alias("opponent"),
        F.concat_ws("-", F.col("home_score").cast("string"), F.col("away_score").cast("string")).alias("score"),
        F.when(home, F.col("home_score") > F.col("away_score"))
         .otherwise(F.col("away_score") > F.col("home_score")).alias("won"),
        "minutes", "points", "reb", "ast", "val",
        (F.col("points") == best).alias("is_best_points"),
    )


def player_shots(players: DataFrame, shots: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Shots joined to the player by game, jersey and side."""
    p = in_context(players, ctx).select(*CTX, "game_id", "player_name", "team", "jersey",
                                        X.shot_side("is_home").alias("side"))
    s = shots.select("game_id", F.col("player").alias("jersey"), F.col("team").alias("side"),
                     "x", "y", "made", "shot_distance_m", "zone")
    return p.join(s, ["game_id", "jersey", "side"])


def zones(players: DataFrame, shots: DataFrame, ctx: Context | None = None,
          by_team: bool = False) -> DataFrame:
    """Made / attempts / pct per player and zone."""
    keys = [*CTX, *(["team"] if by_team else []), "player_name", "zone"]
    d = player_shots(players, shots, ctx).groupBy(*keys).agg(
        F.count_if(F.col("made") == 1).alias("made"), F.count(F.lit(1)).alias("att"))
    return d.withColumn("pct", X.ratio("made", "att"))


def zone_map(players: DataFrame, shots: DataFrame, ctx: Context | None = None,
             by_team: bool = False) -> DataFrame:
    """A14 nested: one map zone -> (made, att, pct) per player."""
    z = zones(players, shots, ctx, by_team)
    return z.groupBy(*CTX, *(["team"] if by_team else []), "player_name").agg(F.map_from_entries(F.collect_list(
        F.struct("zone", F.struct("made", "att", "pct")))).alias("zones"))


def roster(players: DataFrame, shots: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Leader columns per team and player, no thresholds,
    zones attached (empty map when none), points relative to the team's
    best scorer (0-100), which is a window over the team's players."""
    top = F.max("avg_pts").over(Window.partitionBy(*CTX, "team"))
    lines = player_lines(players, ctx, by=("team",)).drop("grp").withColumn("_top", top)
    d = lines.join(zone_map(players, shots, ctx, by_team=True), CTX + ["team", "player_name"], "left")
    none = F.create_map().cast("map<string,struct<made:bigint,att:bigint,pct:double>>")
    share = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("avg_pts") / F.col("_top") * 100))
    return d.withColumns({
        "zones": F.coalesce("zones", none),
        "pts_vs_best": F.coalesce(F.when(F.col("_top") > 0, share), F.lit(0.0))}).drop("_top")


def pace(teams: DataFrame, games: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Each team's games against the rival's box score:
    possessions of both, offensive and defensive rating."""
    g = in_context(games, ctx).select("game_id", *CTX, "grp", "date")
    t = teams.select("game_id", "team_name", "points", "t2a", "t3a", "off_reb", "tov", "fta")
    opp = t.select("game_id", *[F.col(c).alias(f"opp_{c}") for c in t.columns if c != "game_id"])
    d = t.join(opp, "game_id").filter(F.col("team_name") != F.col("opp_team_name")).join(g, "game_id")
    fga = F.coalesce("t2a", F.lit(0)) + F.coalesce("t3a", F.lit(0))
    ofga = F.coalesce("opp_t2a", F.lit(0)) + F.coalesce("opp_t3a", F.lit(0))
    d = d.withColumns({
        "poss_for": X.possessions(fga, F.col("off_reb"), F.col("tov"), F.col("fta"), strict=False),
        "poss_against": X.possessions(ofga, F.col("opp_off_reb"), F.col("opp_tov"), F.col("opp_fta"), strict=False),
    })
    both = (F.col("poss_for") != 0) & (F.col("poss_against") != 0)
    return d.select(
        *CTX, "grp", F.col("team_name").alias("team"), "game_id", "date",
        F.col("opp_team_name").alias("opponent"), F.col("points").alias("points_for"),
        F.col("opp_points").alias("points_against"),
        (F.col("points") > F.col("opp_points")).alias("won"),
        "poss_for", "poss_against",
        F.when(both, (F.col("poss_for") + F.col("poss_against")) / 2).alias("possessions"),
        F.when(F.col("poss_for") != 0, F.col("points") / F.col("poss_for") * 100).alias("ortg"),
        F.when(F.col("poss_against") != 0,
               F.col("opp_points") / F.col("poss_against") * 100).alias("drtg"),
    )


def pace_summary(teams: DataFrame, games: DataFrame, ctx: Context | None = None) -> DataFrame:
    """Team means over non-null games and net rating."""
    d = pace(teams, games, ctx).groupBy(*CTX, "team").agg(
        F.count(F.lit(1)).alias("games"),
        F.avg("possessions").alias("avg_possessions"),
        F.avg("ortg").alias("avg_ortg"), F.avg("drtg").alias("avg_drtg"))
    return d.withColumn("avg_net_rtg", F.col("avg_ortg") - F.col("avg_drtg"))


def player_lookup(players: DataFrame) -> DataFrame:
    """Slug dimension, one row per distinct name and slug."""
    return players.select(F.col("player_name").alias("name")).distinct().withColumn(
        "slug", T.slug(F.col("name")))


def team_lookup(players: DataFrame) -> DataFrame:
    return players.select(F.col("team").alias("name")).distinct().withColumn("slug", T.slug(F.col("name")))


def team_sheet(t, ctx: Context | None = None, slug: str | None = None) -> dict[str, DataFrame]:
    """Team answer: standing row (J14), pace means, game log, roster, shots."""
    st = standings(t.games, ctx)
    if slug is not None:
        st = st.filter(F.col("team_key") == slug)
    keys = st.select(*CTX, "team")
    return {
        "standing": st,
        "pace": pace_summary(t.teams, t.games, ctx).join(keys, CTX + ["team"], "left_semi"),
        "game_log": pace(t.teams, t.games, ctx).join(keys, CTX + ["team"], "left_semi"),
        "roster": roster(t.players, t.shots, ctx).join(keys, CTX + ["team"], "left_semi"),
        "shots": player_shots(t.players, t.shots, ctx).join(keys, CTX + ["team"], "left_semi"),
    }


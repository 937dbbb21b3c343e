"""Registered queries (keys = inventory id + short name) and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog
from .catalog import lake, register, tables
from .oracle.adapters import with_layers as W
from .plans import league
from .functions import expr as X
from .functions.rules import Context
from .plans import nameindex as NX
from .plans.context import catalogue, describe_context
from .sources.lake import read_table as lake_read


def slug_sql(x: str) -> str:
    """F04 in DuckDB: strip accents, drop non-ASCII, lower, runs -> '-'."""
    folded = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    dashed = f"regexp_replace(lower({folded}), '[^a-z0-9]+', '-', 'g')"
    return f"regexp_replace({dashed}, '^-+|-+$', '', 'g')"


# --- league ---------------------------------------------------------------

STANDINGS_SQL = W("games") + f""",
sides AS (
  SELECT competition, season, home_team AS team, home_score AS pf, away_score AS pa FROM games
  UNION ALL
  SELECT competition, season, away_team, away_score, home_score FROM games),
t AS (
  SELECT competition, season, team, count(*) AS games, count(*) FILTER (WHERE pf > pa) AS wins,
         CAST(sum(pf) AS BIGINT) AS points_for, CAST(sum(pa) AS BIGINT) AS points_against
  FROM sides GROUP BY competition, season, team)
SELECT competition, season,
       CAST(row_number() OVER (PARTITION BY competition, season
            ORDER BY wins DESC, points_for - points_against DESC, team) AS INTEGER) AS rank,
       team, {slug_sql('team')} AS team_key, games, wins, games - wins AS losses,
       points_for, points_against, points_for - points_against AS diff
FROM t"""


@register("a16_standings", STANDINGS_SQL)
def a16_standings(spark, sf_dir):
    return league.standings(tables(spark, sf_dir).games)


@register("w06_game_list", W("games") + """,
days AS (
  SELECT competition, season, game_date,
         CAST(dense_rank() OVER (PARTITION BY competition, season ORDER BY game_date DESC) AS INTEGER) AS match_day
  FROM (SELECT DISTINCT competition, season, game_date FROM games))
SELECT g.competition, g.season, grp, game_id, date, match_day, home_team, away_team,
       home_score, away_score
FROM games g JOIN days d ON g.competition = d.competition AND g.season = d.season
 AND g.game_date = d.game_date""")
def w06_game_list(spark, sf_dir):
    return league.game_list(tables(spark, sf_dir).games)


@register("t03_recent_games", W("games") + """
SELECT * FROM (
  SELECT competition, season, game_id, date, home_team, away_team, home_score, away_score,
         CAST(row_number() OVER (PARTITION BY competition, season
              ORDER BY game_date DESC, game_id DESC) AS INTEGER) AS position
  FROM games) WHERE position <= 8""")
def t03_recent_games(spark, sf_dir):
    return league.recent_games(tables(spark, sf_dir).games).drop("game_date")


@register("a09_catalogue", W("games") + """
SELECT competition, season, CAST(season AS VARCHAR) || '/' || CAST(season + 1 AS VARCHAR) AS season_label,
       list_sort(list(DISTINCT grp)) AS groups, count(*) AS games
FROM games GROUP BY competition, season""")
def a09_catalogue(spark, sf_dir):
    return catalogue(tables(spark, sf_dir).games)


@register("p10_context", W("games") + """
SELECT competition, season, CAST(season AS VARCHAR) || '/' || CAST(season + 1 AS VARCHAR) AS season_label,
       count(*) AS games, count(DISTINCT game_date) AS match_days, list_sort(list(DISTINCT grp)) AS groups,
       CASE WHEN count(DISTINCT grp) = 1 THEN min(grp)
            ELSE CAST(count(DISTINCT grp) AS VARCHAR) || ' groups' END AS group_label
FROM games GROUP BY competition, season""")
def p10_context(spark, sf_dir):
    return describe_context(tables(spark, sf_dir).games)


@register("p09_default_context", W("games") + """,
s AS (SELECT season FROM games GROUP BY season ORDER BY count(*) DESC, season DESC LIMIT 1)
SELECT competition, season FROM games WHERE season = (SELECT season FROM s)
GROUP BY competition, season ORDER BY count(*) DESC, competition LIMIT 1""")
def p09_default_context(spark, sf_dir):
    from .plans.context import resolve_context
    return resolve_context(tables(spark, sf_dir).games)


@register("a10_summary", W("games", "shots") + """,
n_games AS (SELECT competition, season, count(*) AS games FROM games GROUP BY ALL),
n_pl AS (SELECT competition, season, count(DISTINCT team) AS teams, count(DISTINCT player_name) AS players
         FROM players GROUP BY ALL),
n_shots AS (SELECT g.competition, g.season, count(*) AS shots
            FROM fshots s JOIN games g ON s.game_id = g.game_id GROUP BY ALL)
SELECT g.competition, g.season, games, coalesce(teams, 0) AS teams, coalesce(players, 0) AS players,
       coalesce(shots, 0) AS shots
FROM n_games g LEFT JOIN n_pl p ON g.competition = p.competition AND g.season = p.season
LEFT JOIN n_shots s ON g.competition = s.competition AND g.season = s.season""")
def a10_summary(spark, sf_dir):
    t = tables(spark, sf_dir)
    return league.summary(t.games, t.players, t.shots)


LEADER_BODY = """
  SELECT competition, season, player_name,
         max({{'d': game_date, 'g': game_id, 'team': team, 'grp': grp, 'jersey': jersey}}) AS last,
         count(*) AS games,
         avg(minutes) AS avg_min, avg(points) AS avg_pts, avg(reb) AS avg_reb, avg(ast) AS avg_ast,
         avg(stl) AS avg_stl, avg(blk) AS avg_blk, avg(tov) AS avg_to, avg(val) AS avg_val,
         avg(plus_minus) AS avg_plus_minus,
         CAST(sum(t2m) AS BIGINT) AS sum_t2m, CAST(sum(t2a) AS BIGINT) AS sum_t2a,
         CAST(sum(t3m) AS BIGINT) AS sum_t3m, CAST(sum(t3a) AS BIGINT) AS sum_t3a,
         CAST(sum(ftm) AS BIGINT) AS sum_ftm, CAST(sum(fta) AS BIGINT) AS sum_fta,
         CAST(sum(points) AS BIGINT) AS total_points
  FROM players {where} GROUP BY competition, season, player_name"""

LEADER_COLS = f"""competition, season, player_name, {slug_sql('player_name')} AS slug,
       last.team AS team, last.grp AS grp, last.jersey AS jersey, games,
       avg_min, avg_pts, avg_reb, avg_ast, avg_stl, avg_blk, avg_to, avg_val, avg_plus_minus,
       sum_t2m, sum_t2a, sum_t3m, sum_t3a, sum_ftm, sum_fta, total_points,
       CASE WHEN sum_t2a > 0 THEN sum_t2m / sum_t2a END AS t2_pct,
       CASE WHEN sum_t3a > 0 THEN sum_t3m / sum_t3a END AS t3_pct,
       CASE WHEN sum_fta > 0 THEN sum_ftm / sum_fta END AS ft_pct,
       CASE WHEN sum_t2a + sum_t3a > 0 THEN (sum_t2m + sum_t3m) / (sum_t2a + sum_t3a) END AS fg_pct,
       CASE WHEN sum_t2a + sum_t3a > 0
            THEN (sum_t2m + sum_t3m + CAST(0.5 AS DOUBLE) * sum_t3m) / (sum_t2a + sum_t3a) END AS efg_pct,
       CASE WHEN sum_t2a + sum_t3a + sum_fta > 0
            THEN total_points / (2 * (sum_t2a + sum_t3a + CAST(0.44 AS DOUBLE) * sum_fta)) END AS ts_pct"""


@register("a11_leaders", W("lines") + f""",
agg AS ({LEADER_BODY.format(where='')}),
pool AS (SELECT {LEADER_COLS} FROM agg WHERE games >= 6 AND avg_min >= 15)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY competition, season
              ORDER BY avg_val DESC, player_name) AS INTEGER) AS position FROM pool)
WHERE position > 0 AND position <= 50""")
def a11_leaders(spark, sf_dir):
    return league.leaders(tables(spark, sf_dir).players)


@register("a12_leaders_total", W("lines") + f""",
agg AS ({LEADER_BODY.format(where='')})
SELECT competition, season, count(*) AS leaders_total FROM agg
WHERE games >= 6 AND avg_min >= 15 GROUP BY competition, season""")
def a12_leaders_total(spark, sf_dir):
    return league.leaders_total(tables(spark, sf_dir).players)


# --- silver and gold layers ------------------------------------------------

from .functions import text as T  # noqa: E402
from .operators import model  # noqa: E402
from .plans import compare as C  # noqa: E402
from .plans import explore as E  # noqa: E402
from .plans import playbyplay as PBP  # noqa: E402
from .plans import sheets as S  # noqa: E402

SILVER_PLAYER_COLS = ["game_id", "competition", "season", "grp", "date", "home_team", "away_team",
                      "is_home", "team", "jersey", "player_name", "minutes", "points", "t2m", "t2a",
                      "t3m", "t3a", "ftm", "fta", "reb", "ast", "stl", "blk", "tov", "pf", "plus_minus",
                      "val", "fgm", "fga", "two_point_pct", "three_point_pct", "free_throw_pct",
                      "field_goal_pct", "effective_fg_pct", "true_shooting_pct", "points_per_36",
                      "rebounds_per_36", "assists_per_36", "steals_per_36", "blocks_per_36",
                      "turnovers_per_36", "fouls_per_36", "val_per_36", "val_per_minute",
                      "double_digit_categories", "is_double_double", "is_triple_double"]

SILVER_PLAYERS_SQL = W("lines") + """,
sp AS (
  SELECT *,
    CASE WHEN t2a > 0 THEN t2m / t2a END AS two_point_pct,
    CASE WHEN t3a > 0 THEN t3m / t3a END AS three_point_pct,
    CASE WHEN fta > 0 THEN ftm / fta END AS free_throw_pct,
    CASE WHEN fga > 0 THEN fgm / fga END AS field_goal_pct,
    CASE WHEN fga > 0 THEN (fgm + CAST(0.5 AS DOUBLE) * t3m) / fga END AS effective_fg_pct,
    CASE WHEN fga + fta > 0 THEN points / (2 * (fga + CAST(0.44 AS DOUBLE) * fta)) END AS true_shooting_pct,
    CASE WHEN minutes > 0 THEN points / minutes * 36 END AS points_per_36,
    CASE WHEN minutes > 0 THEN reb / minutes * 36 END AS rebounds_per_36,
    CASE WHEN minutes > 0 THEN ast / minutes * 36 END AS assists_per_36,
    CASE WHEN minutes > 0 THEN stl / minutes * 36 END AS steals_per_36,
    CASE WHEN minutes > 0 THEN blk / minutes * 36 END AS blocks_per_36,
    CASE WHEN minutes > 0 THEN tov / minutes * 36 END AS turnovers_per_36,
    CASE WHEN minutes > 0 THEN pf / minutes * 36 END AS fouls_per_36,
    CASE WHEN minutes > 0 THEN val / minutes * 36 END AS val_per_36,
    CASE WHEN minutes > 0 THEN val / minutes * 1 END AS val_per_minute,
    CAST(points >= 10 AS INTEGER) + CAST(reb >= 10 AS INTEGER) + CAST(ast >= 10 AS INTEGER)
      + CAST(stl >= 10 AS INTEGER) + CAST(blk >= 10 AS INTEGER) AS double_digit_categories
  FROM players)
SELECT """ + ", ".join(SILVER_PLAYER_COLS[:-2]) + """,
  double_digit_categories >= 2 AS is_double_double, double_digit_categories >= 3 AS is_triple_double
FROM sp"""


@register("b06_silver_players", SILVER_PLAYERS_SQL)
def b06_silver_players(spark, sf_dir):
    return tables(spark, sf_dir).players.select(*SILVER_PLAYER_COLS)


@register("b13_fact_games", W("games") + """
SELECT game_id, competition, season, grp, date, home_team, away_team, home_score, away_score,
       home_score + away_score AS total_points,
       CASE WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' ELSE 'draw' END AS winner,
       abs(home_score - away_score) AS margin
FROM games""")
def b13_fact_games(spark, sf_dir):
    return tables(spark, sf_dir).games.drop("game_date")


@register("b10_team_box", W("teams") + " SELECT * FROM teams")
def b10_team_box(spark, sf_dir):
    return tables(spark, sf_dir).teams


@register("b14_fact_team_games", W("teams") + """,
f AS (SELECT *, t2m + t3m AS fgm, t2a + t3a AS fga FROM teams),
g AS (SELECT *, CASE WHEN fga > 0 THEN fgm / fga END AS fg_pct, CASE WHEN t2a > 0 THEN t2m / t2a END AS t2_pct,
             CASE WHEN t3a > 0 THEN t3m / t3a END AS t3_pct, CASE WHEN fta > 0 THEN ftm / fta END AS ft_pct,
             CASE WHEN fga > 0 THEN (fgm + CAST(0.5 AS DOUBLE) * t3m) / fga END AS effective_fg_pct,
             fga - off_reb + tov + CAST(0.44 AS DOUBLE) * fta AS possessions FROM f)
SELECT *, CASE WHEN possessions > 0 THEN points / possessions * 100 END AS offensive_rating FROM g""")
def b14_fact_team_games(spark, sf_dir):
    return model.fact_team_games(tables(spark, sf_dir).teams)


@register("b15_fact_shots", W("shots") + """
SELECT game_id, quarter, time, player, team, made, x, y, shot_distance_m, is_three, zone, shot_points
FROM fshots""")
def b15_fact_shots(spark, sf_dir):
    return tables(spark, sf_dir).shots


@register("b08_silver_plays", W("plays") + """
SELECT game_id, num, quarter, time, text, team, action, scoreA, scoreB, player_id, team_id, event_id,
       made, shot_value, foul_type, sub_direction, assisted_by_player_id, player_name, assisted_by_name
FROM plays""")
def b08_silver_plays(spark, sf_dir):
    return tables(spark, sf_dir).plays


@register("b11_dim_players", W("lines") + """
SELECT competition, player_name, season, count(DISTINCT game_id) AS games, sum(minutes) AS total_minutes,
  CAST(sum(points) AS BIGINT) AS total_points, CAST(sum(reb) AS BIGINT) AS total_rebounds,
  CAST(sum(ast) AS BIGINT) AS total_assists, CAST(sum(stl) AS BIGINT) AS total_steals,
  CAST(sum(blk) AS BIGINT) AS total_blocks, CAST(sum(tov) AS BIGINT) AS total_turnovers,
  CAST(sum(pf) AS BIGINT) AS total_fouls, CAST(sum(val) AS BIGINT) AS total_val,
  CAST(sum(t2m) AS BIGINT) AS total_2pm, CAST(sum(t2a) AS BIGINT) AS total_2pa,
  CAST(sum(t3m) AS BIGINT) AS total_3pm, CAST(sum(t3a) AS BIGINT) AS total_3pa,
  CAST(sum(ftm) AS BIGINT) AS total_ftm, CAST(sum(fta) AS BIGINT) AS total_fta,
  CAST(sum(fgm) AS BIGINT) AS total_fgm, CAST(sum(fga) AS BIGINT) AS total_fga,
  avg(points) AS ppg, avg(reb) AS rpg, avg(ast) AS apg, avg(minutes) AS mpg, avg(val) AS avg_val,
  avg(plus_minus) AS avg_plus_minus,
  round(avg(CASE WHEN minutes > 0 THEN points / minutes * 36 END), 6) AS avg_points_per_36,
  CAST(sum(CAST(CAST(points >= 10 AS INTEGER) + CAST(reb >= 10 AS INTEGER) + CAST(ast >= 10 AS INTEGER)
      + CAST(stl >= 10 AS INTEGER) + CAST(blk >= 10 AS INTEGER) >= 2 AS INTEGER)) AS BIGINT) AS double_doubles,
  CAST(sum(CAST(CAST(points >= 10 AS INTEGER) + CAST(reb >= 10 AS INTEGER) + CAST(ast >= 10 AS INTEGER)
      + CAST(stl >= 10 AS INTEGER) + CAST(blk >= 10 AS INTEGER) >= 3 AS INTEGER)) AS BIGINT) AS triple_doubles,
  max(points) AS best_points, max(val) AS best_val,
  max({'d': game_date, 'g': game_id, 'team': team, 'grp': grp}).team AS team,
  max({'d': game_date, 'g': game_id, 'team': team, 'grp': grp}).grp AS grp,
  CASE WHEN sum(t2a) > 0 THEN sum(t2m) / sum(t2a) END AS two_point_pct,
  CASE WHEN sum(t3a) > 0 THEN sum(t3m) / sum(t3a) END AS three_point_pct,
  CASE WHEN sum(fta) > 0 THEN sum(ftm) / sum(fta) END AS free_throw_pct,
  CASE WHEN sum(fga) > 0 THEN sum(fgm) / sum(fga) END AS field_goal_pct,
  CASE WHEN sum(fga) > 0 THEN (sum(fgm) + CAST(0.5 AS DOUBLE) * sum(t3m)) / sum(fga) END AS effective_fg_pct,
  CASE WHEN sum(fga) + sum(fta) > 0
       THEN sum(points) / (2 * (sum(fga) + CAST(0.44 AS DOUBLE) * sum(fta))) END AS true_shooting_pct,
  CASE WHEN sum(minutes) > 0 THEN sum(val) / sum(minutes) END AS val_per_minute
FROM players GROUP BY competition, player_name, season""")
def b11_dim_players(spark, sf_dir):
    # mean of non-integral per-game rates: summation order differs between
    # engines in the last bit, so the checked column is rounded to 6 digits
    d = model.dim_players(tables(spark, sf_dir).players)
    return d.withColumn("avg_points_per_36", F.round("avg_points_per_36", 6))


@register("b12_dim_teams", W("teams") + """
SELECT competition, team_id, team_name, season, count(DISTINCT game_id) AS games,
  CAST(sum(points) AS BIGINT) AS total_points, avg(points) AS ppg,
  CAST(sum(tot_reb) AS BIGINT) AS total_rebounds, CAST(sum(ast) AS BIGINT) AS total_assists,
  CAST(sum(t2m) AS BIGINT) AS total_2pm, CAST(sum(t2a) AS BIGINT) AS total_2pa,
  CAST(sum(t3m) AS BIGINT) AS total_3pm, CAST(sum(t3a) AS BIGINT) AS total_3pa,
  CAST(sum(ftm) AS BIGINT) AS total_ftm, CAST(sum(fta) AS BIGINT) AS total_fta,
  CASE WHEN sum(t2a) > 0 THEN sum(t2m) / sum(t2a) END AS two_point_pct,
  CASE WHEN sum(t3a) > 0 THEN sum(t3m) / sum(t3a) END AS three_point_pct,
  CASE WHEN sum(fta) > 0 THEN sum(ftm) / sum(fta) END AS free_throw_pct
FROM teams GROUP BY competition, team_id, team_name, season""")
def b12_dim_teams(spark, sf_dir):
    return model.dim_teams(tables(spark, sf_dir).teams)


# --- sheets ------------------------------------------------------------------

@register("a13_player_sheet", W("lines") + f"""
SELECT competition, season, player_name, {slug_sql('player_name')} AS slug,
  max({{'d': game_date, 'g': game_id, 'team': team, 'grp': grp, 'jersey': jersey}}).team AS team,
  max({{'d': game_date, 'g': game_id, 'team': team, 'grp': grp, 'jersey': jersey}}).grp AS grp,
  max({{'d': game_date, 'g': game_id, 'team': team, 'grp': grp, 'jersey': jersey}}).jersey AS jersey,
  count(*) AS games, sum(minutes) AS sum_minutes,
  CAST(sum(points) AS BIGINT) AS sum_points, CAST(sum(reb) AS BIGINT) AS sum_reb, CAST(sum(ast) AS BIGINT) AS sum_ast,
  CAST(sum(stl) AS BIGINT) AS sum_stl, CAST(sum(blk) AS BIGINT) AS sum_blk, CAST(sum(tov) AS BIGINT) AS sum_tov,
  CAST(sum(pf) AS BIGINT) AS sum_pf, CAST(sum(val) AS BIGINT) AS sum_val, CAST(sum(t2m) AS BIGINT) AS sum_t2m,
  CAST(sum(t2a) AS BIGINT) AS sum_t2a, CAST(sum(t3m) AS BIGINT) AS sum_t3m, CAST(sum(t3a) AS BIGINT) AS sum_t3a,
  CAST(sum(ftm) AS BIGINT) AS sum_ftm, CAST(sum(fta) AS BIGINT) AS sum_fta,
  sum(minutes) / count(*) AS per_game_minutes, sum(points) / count(*) AS per_game_points,
  sum(reb) / count(*) AS per_game_reb, sum(ast) / count(*) AS per_game_ast, sum(stl) / count(*) AS per_game_stl,
  sum(blk) / count(*) AS per_game_blk, sum(tov) / count(*) AS per_game_tov, sum(val) / count(*) AS per_game_val,
  avg(plus_minus) AS avg_plus_minus,
  CASE WHEN sum(t2a) > 0 THEN sum(t2m) / sum(t2a) END AS t2_pct,
  CASE WHEN sum(t3a) > 0 THEN sum(t3m) / sum(t3a) END AS t3_pct,
  CASE WHEN sum(fta) > 0 THEN sum(ftm) / sum(fta) END AS ft_pct,
  CASE WHEN sum(fga) > 0 THEN sum(fgm) / sum(fga) END AS fg_pct,
  CASE WHEN sum(fga) > 0 THEN (sum(fgm) + CAST(0.5 AS DOUBLE) * sum(t3m)) / sum(fga) END AS efg_pct,
  CASE WHEN sum(fga) + sum(fta) > 0 THEN sum(points) / (2 * (sum(fga) + CAST(0.44 AS DOUBLE) * sum(fta))) END AS ts_pct,
  CASE WHEN sum(minutes) > 0 THEN sum(points) / sum(minutes) * 36 END AS per36_points,
  CASE WHEN sum(minutes) > 0 THEN sum(reb) / sum(minutes) * 36 END AS per36_reb,
  CASE WHEN sum(minutes) > 0 THEN sum(ast) / sum(minutes) * 36 END AS per36_ast,
  max(points) AS best_points, max(reb) AS best_reb, max(ast) AS best_ast, max(val) AS best_val
FROM players GROUP BY competition, season, player_name""")
def a13_player_sheet(spark, sf_dir):
    return S.player_sheet(tables(spark, sf_dir).players)


@register("j06_game_log", W("games") + """,
d AS (SELECT p.competition, p.season, p.player_name, p.game_id, g.date, p.is_home, p.minutes, p.points, p.reb,
             p.ast, p.val, g.home_team AS ht, g.away_team AS awt, g.home_score AS hs, g.away_score AS as_
      FROM players p JOIN games g ON p.game_id = g.game_id)
SELECT competition, season, player_name, game_id, date, is_home,
       CASE WHEN is_home THEN awt ELSE ht END AS opponent,
       CAST(hs AS VARCHAR) || '-' || CAST(as_ AS VARCHAR) AS score,
       CASE WHEN is_home THEN hs > as_ ELSE as_ > hs END AS won,
       minutes, points, reb, ast, val,
       points = max(points) OVER (PARTITION BY competition, season, player_name) AS is_best_points
FROM d""")
def j06_game_log(spark, sf_dir):
    t = tables(spark, sf_dir)
    return S.game_log(t.players, t.games)


ZONES_SQL = W("shots") + """,
ps AS (
  SELECT p.competition, p.season, p.team, p.player_name, s.zone, s.made
  FROM players p JOIN fshots s ON p.game_id = s.game_id AND p.jersey = s.player
   AND s.team = CASE WHEN p.is_home THEN 0 ELSE 1 END)"""


@register("a14_zones", ZONES_SQL + """
SELECT competition, season, player_name, zone, count(*) FILTER (WHERE made = 1) AS made, count(*) AS att,
       count(*) FILTER (WHERE made = 1) / count(*) AS pct
FROM ps GROUP BY competition, season, player_name, zone""")
def a14_zones(spark, sf_dir):
    t = tables(spark, sf_dir)
    return S.zones(t.players, t.shots)


@register("j07_player_shots", W("shots") + """
SELECT p.competition, p.season, p.game_id, p.player_name, p.team, p.jersey,
       CASE WHEN p.is_home THEN 0 ELSE 1 END AS side, s.x, s.y, s.made, s.shot_distance_m, s.zone
FROM players p JOIN fshots s ON p.game_id = s.game_id AND p.jersey = s.player
 AND s.team = CASE WHEN p.is_home THEN 0 ELSE 1 END""")
def j07_player_shots(spark, sf_dir):
    t = tables(spark, sf_dir)
    return S.player_shots(t.players, t.shots)


ROSTER_COLS = ["competition", "season", "team", "player_name", "slug", "jersey", "games", "avg_min",
               "avg_pts", "avg_reb", "avg_ast", "avg_val", "sum_t2m", "sum_t2a", "sum_t3m", "sum_t3a",
               "total_points", "ts_pct", "pts_vs_best", "zone_att"]


@register("a15_roster", W("shots") + f""",
agg AS (
  SELECT competition, season, team, player_name,
    max({{'d': game_date, 'g': game_id, 'team': team, 'grp': grp, 'jersey': jersey}}).jersey AS jersey,
    count(*) AS games, avg(minutes) AS avg_min, avg(points) AS avg_pts, avg(reb) AS avg_reb,
    avg(ast) AS avg_ast, avg(val) AS avg_val,
    CAST(sum(t2m) AS BIGINT) AS sum_t2m, CAST(sum(t2a) AS BIGINT) AS sum_t2a,
    CAST(sum(t3m) AS BIGINT) AS sum_t3m, CAST(sum(t3a) AS BIGINT) AS sum_t3a,
    CAST(sum(fta) AS BIGINT) AS sum_fta, CAST(sum(points) AS BIGINT) AS total_points
  FROM players GROUP BY competition, season, team, player_name),
ps AS (
  SELECT p.competition, p.season, p.team, p.player_name, s.zone, s.made
  FROM players p JOIN fshots s ON p.game_id = s.game_id AND p.jersey = s.player
   AND s.team = CASE WHEN p.is_home THEN 0 ELSE 1 END),
z AS (SELECT competition, season, team, player_name, count(*) AS zone_att FROM ps GROUP BY ALL),
r AS (
  SELECT a.*, coalesce(z.zone_att, 0) AS zone_att,
         max(avg_pts) OVER (PARTITION BY a.competition, a.season, a.team) AS top
  FROM agg a LEFT JOIN z ON a.competition = z.competition AND a.season = z.season AND a.team = z.team
   AND a.player_name = z.player_name)
SELECT competition, season, team, player_name, {slug_sql('player_name')} AS slug, jersey, games, avg_min,
  avg_pts, avg_reb, avg_ast, avg_val, sum_t2m, sum_t2a, sum_t3m, sum_t3a, total_points,
  CASE WHEN sum_t2a + sum_t3a + sum_fta > 0
       THEN total_points / (2 * (sum_t2a + sum_t3a + CAST(0.44 AS DOUBLE) * sum_fta)) END AS ts_pct,
  coalesce(CASE WHEN top > 0 THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, avg_pts / top * 100)) END, 0.0::DOUBLE) AS pts_vs_best,
  zone_att
FROM r""")
def a15_roster(spark, sf_dir):
    t = tables(spark, sf_dir)
    r = S.roster(t.players, t.shots)
    r = r.withColumn("zone_att", F.aggregate(F.map_values("zones"), F.lit(0).cast("long"),
                                             lambda acc, v: acc + v["att"]))
    return r.select(*ROSTER_COLS)


PACE_SQL = W("games", "teams") + """,
pg AS (
  SELECT g.competition, g.season, g.grp, e.team_name AS team, e.game_id, g.date,
         o.team_name AS opponent, e.points AS points_for, o.points AS points_against,
         e.points > o.points AS won,
         coalesce(e.t2a, 0) + coalesce(e.t3a, 0) - coalesce(e.off_reb, 0) + coalesce(e.tov, 0)
           + CAST(0.44 AS DOUBLE) * coalesce(e.fta, 0) AS poss_for,
         coalesce(o.t2a, 0) + coalesce(o.t3a, 0) - coalesce(o.off_reb, 0) + coalesce(o.tov, 0)
           + CAST(0.44 AS DOUBLE) * coalesce(o.fta, 0) AS poss_against
  FROM teams e JOIN teams o ON e.game_id = o.game_id AND e.team_name <> o.team_name
  JOIN games g ON g.game_id = e.game_id),
pace AS (
  SELECT *, CASE WHEN poss_for <> 0 AND poss_against <> 0 THEN (poss_for + poss_against) / 2 END AS possessions,
         CASE WHEN poss_for <> 0 THEN points_for / poss_for * 100 END AS ortg,
         CASE WHEN poss_against <> 0 THEN points_against / poss_against * 100 END AS drtg
  FROM pg)"""


@register("j08_pace_log", PACE_SQL + " SELECT * FROM pace")
def j08_pace_log(spark, sf_dir):
    t = tables(spark, sf_dir)
    return S.pace(t.teams, t.games)


@register("a17_pace", PACE_SQL + """
SELECT competition, season, team, count(*) AS games, round(avg(possessions), 6) AS avg_possessions,
       round(avg(ortg), 6) AS avg_ortg, round(avg(drtg), 6) AS avg_drtg,
       round(avg(ortg) - avg(drtg), 6) AS avg_net_rtg
FROM pace GROUP BY competition, season, team""")
def a17_pace(spark, sf_dir):
    # means of non-integral ratings: rounded to 6 digits for the check
    t = tables(spark, sf_dir)
    d = S.pace_summary(t.teams, t.games)
    return d.withColumns({c: F.round(c, 6) for c in ("avg_possessions", "avg_ortg", "avg_drtg", "avg_net_rtg")})


@register("j13_player_slugs", W("lines") + f"""
SELECT DISTINCT player_name AS name, {slug_sql('player_name')} AS slug FROM players""")
def j13_player_slugs(spark, sf_dir):
    return S.player_lookup(tables(spark, sf_dir).players)


@register("j13_team_slugs", W("lines") + f"""
SELECT DISTINCT team AS name, {slug_sql('team')} AS slug FROM players""")
def j13_team_slugs(spark, sf_dir):
    return S.team_lookup(tables(spark, sf_dir).players)


# --- play-by-play ------------------------------------------------------------

SCORED_SQL = W("games", "plays") + """,
pj AS (
  SELECT p.*, g.competition, g.season, g.grp,
         CASE WHEN p.team = 1 THEN g.home_team ELSE g.away_team END AS team_name,
         coalesce(TRY_CAST(split_part(p.time, ':', 1) AS INTEGER), 0) * 60
           + coalesce(TRY_CAST(split_part(p.time, ':', 2) AS INTEGER), 0) AS secs_left
  FROM plays p JOIN games g ON p.game_id = g.game_id),
scored AS (
  SELECT *, max(scoreA) OVER w AS score_home, max(scoreB) OVER w AS score_away FROM pj
  WINDOW w AS (PARTITION BY game_id ORDER BY quarter NULLS FIRST, 600 - secs_left, num
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
clutch AS (
  SELECT * FROM scored WHERE player_name IS NOT NULL
    AND (quarter > 4 OR (quarter = 4 AND secs_left <= 300)) AND abs(score_home - score_away) <= 5)"""


@register("w03_running_score", SCORED_SQL + """
SELECT game_id, num, quarter, time, secs_left, 600 - secs_left AS elapsed, score_home, score_away FROM scored""")
def w03_running_score(spark, sf_dir):
    t = tables(spark, sf_dir)
    return PBP.running_score(PBP.with_games(t.plays, t.games)).select("game_id", "num", "quarter", "time", "secs_left", "elapsed",
                                             "score_home", "score_away")


@register("a18_clutch", SCORED_SQL + f""",
agg AS (
  SELECT competition, season, player_name, max({{'g': game_id, 't': team_name}}).t AS team,
    count(DISTINCT game_id) AS games,
    count(*) FILTER (WHERE action = 'shoot') AS fga,
    count(*) FILTER (WHERE action = 'shoot' AND made = 1) AS fgm,
    count(*) FILTER (WHERE action = 'shoot' AND shot_value = 3) AS fg3a,
    count(*) FILTER (WHERE action = 'shoot' AND shot_value = 3 AND made = 1) AS fg3m,
    count(*) FILTER (WHERE action = 'fthrow') AS fta,
    count(*) FILTER (WHERE action = 'fthrow' AND made = 1) AS ftm,
    CAST(coalesce(sum(CASE WHEN action = 'shoot' AND made = 1 THEN shot_value END), 0)
      + count(*) FILTER (WHERE action = 'fthrow' AND made = 1) AS BIGINT) AS points,
    count(*) FILTER (WHERE action = 'assist') AS ast, count(*) FILTER (WHERE action = 'lose') AS tov,
    count(*) FILTER (WHERE action = 'recovery') AS stl, count(*) FILTER (WHERE action = 'blockshot') AS blk,
    count(*) FILTER (WHERE action = 'foul') AS fouls
  FROM clutch GROUP BY competition, season, player_name HAVING count(DISTINCT game_id) >= 2)
SELECT competition, season,
  CAST(row_number() OVER (PARTITION BY competition, season ORDER BY points DESC, player_name) AS INTEGER) AS position,
  player_name, {slug_sql('player_name')} AS slug, team, games, points, ast, tov, stl, blk, fouls,
  fgm, fga, CASE WHEN fga > 0 THEN fgm / fga END AS fg_pct, fg3m, fg3a,
  CASE WHEN fg3a > 0 THEN fg3m / fg3a END AS fg3_pct, ftm, fta, CASE WHEN fta > 0 THEN ftm / fta END AS ft_pct
FROM agg""")
def a18_clutch(spark, sf_dir):
    t = tables(spark, sf_dir)
    return PBP.clutch(t.plays, t.games)


EDGES_SQL = W("games", "plays") + """,
e AS (
  SELECT g.competition, g.season, p.assisted_by_name AS passer, p.player_name AS scorer,
         CASE WHEN p.team = 1 THEN g.home_team ELSE g.away_team END AS team,
         count(*) AS assists, CAST(coalesce(sum(p.shot_value), 0) AS BIGINT) AS points
  FROM plays p JOIN games g ON p.game_id = g.game_id
  WHERE p.action = 'shoot' AND p.made = 1 AND p.assisted_by_name IS NOT NULL AND p.player_name IS NOT NULL
  GROUP BY ALL),
edges AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY competition, season
                   ORDER BY assists DESC, passer, scorer, team) AS INTEGER) AS edge_rank FROM e)
  WHERE edge_rank <= 300)"""


@register("a19_assist_edges", EDGES_SQL + " SELECT * FROM edges")
def a19_assist_edges(spark, sf_dir):
    t = tables(spark, sf_dir)
    return PBP.assist_edges(t.plays, t.games)


@register("a20_assist_nodes", EDGES_SQL + f""",
roles AS (
  SELECT competition, season, team, edge_rank, passer AS name, assists AS given, 0 AS received, 0 AS created FROM edges
  UNION ALL
  SELECT competition, season, team, edge_rank, scorer, 0, assists, points FROM edges),
n AS (
  SELECT competition, season, name, min({{'r': edge_rank, 't': team}}).t AS team,
         CAST(sum(given) AS BIGINT) AS assists_given, CAST(sum(received) AS BIGINT) AS assists_received,
         CAST(sum(created) AS BIGINT) AS points_created
  FROM roles GROUP BY competition, season, name)
SELECT competition, season, name, {slug_sql('name')} AS slug, team, assists_given, assists_received, points_created,
  CAST(row_number() OVER (PARTITION BY competition, season
       ORDER BY assists_given + assists_received DESC, name) AS INTEGER) AS node_rank
FROM n""")
def a20_assist_nodes(spark, sf_dir):
    t = tables(spark, sf_dir)
    return PBP.assist_nodes(PBP.assist_edges(t.plays, t.games))


FOULS_SQL = W("games", "plays") + """,
fg AS (
  SELECT g.competition, g.season, p.player_name, p.game_id,
         count(*) FILTER (WHERE foul_type = 'personal') AS personal,
         count(*) FILTER (WHERE foul_type = 'technical') AS technical,
         count(*) FILTER (WHERE foul_type = 'disqualifying') AS disqualifying
  FROM plays p JOIN games g ON p.game_id = g.game_id
  WHERE p.action = 'foul' AND p.player_name IS NOT NULL GROUP BY ALL),
base AS (
  SELECT competition, season, player_name,
         max({'d': game_date, 'g': game_id, 'team': team, 'grp': grp}).team AS team,
         max({'d': game_date, 'g': game_id, 'team': team, 'grp': grp}).grp AS grp,
         count(*) AS games
  FROM players GROUP BY competition, season, player_name)"""


@register("a21_player_fouls", FOULS_SQL + f""",
per AS (
  SELECT competition, season, player_name, CAST(sum(personal) AS BIGINT) AS personal_fouls,
         CAST(sum(technical) AS BIGINT) AS technical_fouls, CAST(sum(disqualifying) AS BIGINT) AS disqualifying_fouls,
         count(*) AS games_with_foul, count(*) FILTER (WHERE personal >= 5) AS fouled_out_games
  FROM fg GROUP BY ALL),
d AS (
  SELECT p.*, b.team, b.grp, b.games,
         personal_fouls + technical_fouls + disqualifying_fouls AS total_fouls
  FROM per p JOIN base b USING (competition, season, player_name) WHERE b.games >= 3)
SELECT competition, season,
  CAST(row_number() OVER (PARTITION BY competition, season ORDER BY total_fouls DESC, player_name) AS INTEGER) AS position,
  player_name, {slug_sql('player_name')} AS slug, team, grp, games, personal_fouls, technical_fouls,
  disqualifying_fouls, total_fouls, total_fouls / games AS fouls_per_game, games_with_foul, fouled_out_games
FROM d""")
def a21_player_fouls(spark, sf_dir):
    t = tables(spark, sf_dir)
    return PBP.player_fouls(t.plays, t.games, t.players)


@register("a22_team_fouls", FOULS_SQL + f""",
sides AS (
  SELECT competition, season, home_team AS team FROM games UNION ALL
  SELECT competition, season, away_team FROM games),
st AS (SELECT competition, season, team, count(*) AS games FROM sides GROUP BY ALL),
per AS (
  SELECT f.competition, f.season, b.team, CAST(sum(personal) AS BIGINT) AS personal_fouls,
         CAST(sum(technical) AS BIGINT) AS technical_fouls, CAST(sum(disqualifying) AS BIGINT) AS disqualifying_fouls
  FROM fg f JOIN base b USING (competition, season, player_name) GROUP BY ALL),
d AS (
  SELECT p.*, s.games, personal_fouls + technical_fouls + disqualifying_fouls AS total_fouls
  FROM per p JOIN st s USING (competition, season, team) WHERE s.games >= 3)
SELECT competition, season,
  CAST(row_number() OVER (PARTITION BY competition, season
       ORDER BY coalesce(total_fouls / games, 0) DESC, team) AS INTEGER) AS position,
  team, {slug_sql('team')} AS team_key, games, personal_fouls, technical_fouls, disqualifying_fouls,
  total_fouls, total_fouls / games AS fouls_per_game
FROM d""")
def a22_team_fouls(spark, sf_dir):
    t = tables(spark, sf_dir)
    return PBP.team_fouls(t.plays, t.games, t.players)


# --- compare, search, exploration ---------------------------------------------

POOL_SQL = W("lines") + f""",
agg AS ({LEADER_BODY.format(where='')}),
pool AS (SELECT {LEADER_COLS} FROM agg WHERE games >= 6 AND avg_min >= 15)"""


def _unpivot(rel: str, axes) -> str:
    return " UNION ALL ".join(
        f"SELECT competition, season, player_name, '{a}' AS axis, CAST({c} AS DOUBLE) AS value FROM {rel}"
        for a, c in axes)


@register("w05_percentiles", POOL_SQL + f""",
l AS ({_unpivot('pool', C.AXES)}),
nn AS (SELECT *, count(*) OVER (PARTITION BY competition, season, axis ORDER BY value
                  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below,
              count(*) OVER (PARTITION BY competition, season, axis) AS total
       FROM l WHERE value IS NOT NULL)
SELECT l.competition, l.season, l.player_name, l.axis, l.value,
       CAST(round(nn.below / nn.total * 100) AS INTEGER) AS percentile
FROM l LEFT JOIN nn ON l.competition = nn.competition AND l.season = nn.season
 AND l.player_name = nn.player_name AND l.axis = nn.axis""")
def w05_percentiles(spark, sf_dir):
    pool = C.leader_pool(tables(spark, sf_dir).players)
    return C.percentiles(pool)


@register("a26_compare_best", POOL_SQL + f""",
cmp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competition, season
        ORDER BY avg_val DESC, player_name) AS position FROM pool) WHERE position <= 4),
l AS ({_unpivot('cmp', C.BEST_ROWS).replace("AS axis", "AS metric")})
SELECT competition, season, player_name, metric, value,
       (count(*) OVER w > 1) AND value IS NOT NULL AND value = max(value) OVER w AS is_best
FROM l WINDOW w AS (PARTITION BY competition, season, metric)""")
def a26_compare_best(spark, sf_dir):
    pool = C.leader_pool(tables(spark, sf_dir).players)
    return C.best_of(C.compared(pool, 4))


SEARCH_TEXT = "Ibáñez"


def _fold_sql(x: str) -> str:
    return f"lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))"


@register("p14_search", POOL_SQL + f"""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY competition, season
                 ORDER BY avg_val DESC, player_name) AS INTEGER) AS position
  FROM pool WHERE contains({_fold_sql('player_name')}, 'ibanez') OR contains({_fold_sql('team')}, 'ibanez'))
WHERE position > 0 AND position <= 8""")
def p14_search(spark, sf_dir):
    pool = C.leader_pool(tables(spark, sf_dir).players)
    return C.search(pool, SEARCH_TEXT)


EXPLORE_SUMS = ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" if c != "minutes" else "sum(minutes) AS minutes" for c in E.SUMMED)


@register("a23_team_day", W("lines") + f""",
d AS (SELECT team, date, {EXPLORE_SUMS} FROM players GROUP BY team, date),
e AS (SELECT *, t2m + t3m AS fg_made, t2a + t3a AS fg_attempted, minutes / 40 AS pace FROM d)
SELECT *, CASE WHEN fg_attempted > 0 THEN fg_made / fg_attempted ELSE 0.0::DOUBLE END AS fg_percentage,
       CASE WHEN t3a > 0 THEN t3m / t3a ELSE 0.0::DOUBLE END AS three_p_percentage,
       CASE WHEN fta > 0 THEN ftm / fta ELSE 0.0::DOUBLE END AS ft_percentage,
       points / CASE WHEN pace = 0 THEN 1.0::DOUBLE ELSE pace END AS efficiency
FROM e""")
def a23_team_day(spark, sf_dir):
    return E.team_day(tables(spark, sf_dir).players)


CAREER_SQL = W("lines") + f""",
d AS (SELECT player_name, {EXPLORE_SUMS}, avg(val) AS efficiency, count(game_id) AS games
      FROM players GROUP BY player_name),
career AS (
  SELECT *, t2m + t3m AS fg_made, t2a + t3a AS fg_attempted,
         CASE WHEN t2a + t3a > 0 THEN (t2m + t3m) / (t2a + t3a) ELSE 0.0::DOUBLE END AS fg_percentage,
         CASE WHEN t3a > 0 THEN t3m / t3a ELSE 0.0::DOUBLE END AS three_p_percentage,
         CASE WHEN fta > 0 THEN ftm / fta ELSE 0.0::DOUBLE END AS ft_percentage,
         points / games AS ppg, reb / games AS rpg, ast / games AS apg, blk / games AS bpg, stl / games AS spg
  FROM d)"""


@register("a24_career", CAREER_SQL + " SELECT * FROM career")
def a24_career(spark, sf_dir):
    return E.career(tables(spark, sf_dir).players)


@register("t05_top_scorers", CAREER_SQL + """
SELECT player_name, games, points, ppg, fg_percentage, three_p_percentage, ft_percentage
FROM career ORDER BY points DESC, player_name LIMIT 10""")
def t05_top_scorers(spark, sf_dir):
    return E.top_scorers(tables(spark, sf_dir).players)


@register("a25_player_count", W("lines") + " SELECT count(DISTINCT player_name) AS players FROM players")
def a25_player_count(spark, sf_dir):
    return E.player_count(tables(spark, sf_dir).players)


# --- pages, ingestion, quality -------------------------------------------------

from .plans import ingest as I  # noqa: E402
from .plans import quality as Q  # noqa: E402
from .sources import driver as D  # noqa: E402
from .sources import pages as PG  # noqa: E402


@register("h01_page_links", """
WITH l AS (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link,
         generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i
  FROM pages),
f AS (SELECT page_id, link, min(i) AS first_i FROM l GROUP BY page_id, link)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_i) - 1 AS INTEGER) AS position, link
FROM f""")
def h01_page_links(spark, sf_dir):
    return PG.page_links(D.read(spark, sf_dir, "pages"), PG.ANY_LINK)


from .sources import site as SITE  # noqa: E402

DAYS_SQL = W("games") + """,
days AS (SELECT competition, season, game_date, min(game_id) AS page_id FROM games GROUP BY ALL),"""


def _day_pages(spark, sf_dir):
    return SITE.day_pages(tables(spark, sf_dir).games)


def _game_pages(spark, sf_dir):
    t = tables(spark, sf_dir)
    return SITE.game_pages(t.players, t.games, dealt=t.dealt)


@register("h01_game_links", DAYS_SQL + """
l AS (SELECT d.page_id, g.game_id, row_number() OVER (PARTITION BY d.page_id ORDER BY g.game_id) AS i
      FROM days d JOIN games g ON g.competition = d.competition AND g.season = d.season AND g.game_date = d.game_date)
SELECT page_id, CAST(i - 1 AS INTEGER) AS position, CAST(game_id AS VARCHAR) AS link FROM l""")
def h01_game_links(spark, sf_dir):
    """H01 on match-day pages written from the games table."""
    return PG.page_links(_day_pages(spark, sf_dir), PG.GAME_LINK)


@register("h02_page_options", DAYS_SQL + """
o AS (SELECT DISTINCT d.page_id, g.grp
      FROM days d JOIN games g ON g.competition = d.competition AND g.season = d.season AND g.game_date = d.game_date)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY grp) AS INTEGER) AS position, grp AS value,
       'Liga Regular "' || grp || '"' AS label FROM o""")
def h02_page_options(spark, sf_dir):
    """H02 on match-day pages: the menu of groups (its first option is blank)."""
    return PG.page_options(_day_pages(spark, sf_dir).where("first_row = 0"), "grupos")


@register("h03_game_page_header", W("games") + """
SELECT game_id, game_id AS page_id, date, '18:30' AS time, 'Pabellón Norte' AS venue, home_team, away_team,
       home_score, away_score FROM games""")
def h03_game_page_header(spark, sf_dir):
    """H03 on game pages written from the games and player tables."""
    return PG.page_header(_game_pages(spark, sf_dir).where("first_row = 0"))


H03_SQL = r"""
WITH p0 AS (
  SELECT page_id, url, html,
         regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
                        '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t0
  FROM pages),
p AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t0, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t,
         regexp_extract_all(html, 'Equipo\.aspx\?i=[^"]*"[^>]*>([^<]+)<', 1) AS teams
  FROM p0),
q AS (SELECT *, coalesce(trim(teams[1]), '') AS home_team, coalesce(trim(teams[2]), '') AS away_team FROM p)
SELECT TRY_CAST(NULLIF(regexp_extract(url, '(?:partido/|p=)(\d+)', 1), '') AS BIGINT) AS game_id, page_id,
  regexp_extract(t, 'Fecha\s+(\d{2}/\d{2}/\d{4})', 1) AS date,
  regexp_extract(t, 'Fecha\s+\d{2}/\d{2}/\d{4}\s*-\s*(\d{2}:\d{2})', 1) AS time,
  trim(regexp_extract(t, 'Pista\s+(\S+(?:\s+\S+)*?)\s*%', 1)) AS venue,
  home_team, away_team,
  CASE WHEN home_team <> '' AND away_team <> '' THEN coalesce(TRY_CAST(NULLIF(regexp_extract(t,
    '\Q' || home_team || '\E\s+(\d+)\s+p\s+(\d+)\s+\Q' || away_team || '\E', 1), '') AS INTEGER), 0)
    ELSE 0 END AS home_score,
  CASE WHEN home_team <> '' AND away_team <> '' THEN coalesce(TRY_CAST(NULLIF(regexp_extract(t,
    '\Q' || home_team || '\E\s+(\d+)\s+p\s+(\d+)\s+\Q' || away_team || '\E', 2), '') AS INTEGER), 0)
    ELSE 0 END AS away_score
FROM q"""


@register("h03_page_header", H03_SQL)
def h03_page_header(spark, sf_dir):
    return PG.page_header(D.read(spark, sf_dir, "pages"))


@register("h04_page_box_scores", W("games") + """
SELECT p.game_id AS page_id, is_home, CAST(row_number() OVER (
         PARTITION BY p.game_id, is_home ORDER BY jersey, player_name) - 1 AS INTEGER) AS row_index, jersey,
       player_name AS name, CAST(jersey AS VARCHAR) AS player_ref, minutes, points, t2m, t2a, t3m, t3a, ftm, fta,
       orb, drb, reb, ast, stl, blk, tov, pf, plus_minus, val
FROM players p JOIN games g ON p.game_id = g.game_id""")
def h04_page_box_scores(spark, sf_dir):
    """H04/H05 on game pages written from the games and player tables."""
    return PG.page_box_scores(_game_pages(spark, sf_dir))


@register("q00_quality")
def q00_quality(spark, sf_dir):
    return Q.check(tables(spark, sf_dir))


PLAN_SQL = W("headers") + """,
plan AS (
  SELECT h.game_id, h.competition, h.grp AS group_name,
         CASE WHEN s.game_id IS NOT NULL THEN 'skipped' WHEN p.game_id IS NOT NULL THEN 'new'
              ELSE 'pending' END AS status
  FROM hdr h
  LEFT JOIN (SELECT DISTINCT user_id AS game_id FROM events) s ON h.game_id = s.game_id
  LEFT JOIN (SELECT DISTINCT l_orderkey AS game_id FROM lineitem) p ON h.game_id = p.game_id)"""


def _plan(spark, sf_dir):
    h = D.headers(spark, sf_dir).select("game_id", "competition", F.col("grp").alias("group_name"))
    stored = D.read(spark, sf_dir, "events").select(F.col("user_id").alias("game_id"))
    played = D.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"))
    return I.plan_ingest(h, stored, played)


@register("h06_plan_ingest", PLAN_SQL + " SELECT * FROM plan")
def h06_plan_ingest(spark, sf_dir):
    return _plan(spark, sf_dir)


@register("h08_ingest_summary", PLAN_SQL + """
SELECT competition, count(*) FILTER (WHERE status = 'new') AS new,
       count(*) FILTER (WHERE status = 'skipped') AS skipped,
       count(*) FILTER (WHERE status = 'pending') AS pending,
       count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'deferred') AS deferred
FROM plan GROUP BY ROLLUP (competition)""")
def h08_ingest_summary(spark, sf_dir):
    return I.ingest_summary(_plan(spark, sf_dir))


AUDIT_RENAMES = {"5-LOW": "LOW"}
AUDIT_INVALID = ["3-MEDIUM"]
AUDIT_BAD_GROUPS = ["P"]


def _audit(spark, sf_dir):
    """Audit of a written raw store: every game's document, and a second
    copy of the group F games of a renamed competition under its new key (a
    move begun earlier)."""
    return I.audit_taxonomy(catalog.raw_store(spark, sf_dir), AUDIT_RENAMES, AUDIT_INVALID, AUDIT_BAD_GROUPS)


AUDIT_SQL = W("lines") + """,
stored AS (
  SELECT DISTINCT competition, season, grp, game_id FROM players
  UNION ALL SELECT DISTINCT 'LOW', season, grp, game_id FROM players WHERE competition = '5-LOW' AND grp = 'F'),
audit AS (
  SELECT competition, CAST(season AS VARCHAR) AS season, grp, game_id,
    CASE WHEN competition = '5-LOW' THEN 'LOW' ELSE competition END AS target,
    CASE WHEN competition = '3-MEDIUM' THEN 'drop:competition' WHEN grp = 'P' THEN 'drop:group'
         WHEN competition = '5-LOW' THEN 'move' ELSE 'keep' END AS action
  FROM stored)"""


@register("h12_audit_taxonomy", AUDIT_SQL + """
SELECT *, CASE WHEN action = 'move' THEN 'competition=LOW/year=' || season || '/group=' || grp END AS new_folder FROM audit""")
def h12_audit_taxonomy(spark, sf_dir):
    folder = F.nullif(F.regexp_extract("new_path", "(competition=[^/]+/year=[^/]+/group=[^/]+)/", 1), F.lit(""))
    return _audit(spark, sf_dir).withColumn("new_folder", folder).drop("path", "new_path")


@register("h15_move_summary", AUDIT_SQL + """
SELECT competition AS "from", target AS "to", action, count(*) AS paths FROM audit GROUP BY ALL""")
def h15_move_summary(spark, sf_dir):
    return I.move_summary(_audit(spark, sf_dir))


@register("h13_collisions", AUDIT_SQL + """
SELECT DISTINCT m.game_id, m.target AS competition FROM audit m
WHERE m.action = 'move' AND EXISTS (SELECT 1 FROM audit k WHERE k.game_id = m.game_id AND k.competition = m.target)""")
def h13_collisions(spark, sf_dir):
    return I.collisions(_audit(spark, sf_dir))


@register("h14_backup_needed", AUDIT_SQL + """
SELECT competition, season, grp, game_id, action FROM audit WHERE action LIKE 'drop%'""")
def h14_backup_needed(spark, sf_dir):
    """Documents to drop that hold players (all stored ones do)."""
    return I.backup_needed(_audit(spark, sf_dir), catalog.raw_store(spark, sf_dir)).select(
        "competition", "season", "grp", "game_id", "action")


def _migrated(spark, sf_dir, store):
    """Player rows per document header of a store that the migration left."""
    stores = catalog.migrated(spark, sf_dir, AUDIT_RENAMES, AUDIT_INVALID, AUDIT_BAD_GROUPS)
    docs = LK.read_games(spark, stores[store])
    return LK.bronze_players(docs).groupBy("competition", "season", "grp", "game_id").agg(F.count(F.lit(1)).alias("lines"))


MIGRATED_SQL = W("lines") + """
SELECT CASE WHEN {moved} THEN 'LOW' ELSE competition END AS competition, season, grp, game_id, count(*) AS lines
FROM players WHERE {kept} GROUP BY ALL"""
KEPT_SQL = "competition <> '3-MEDIUM' AND grp <> 'P'"


@register("h16_migrated_store", MIGRATED_SQL.format(moved="competition = '5-LOW'", kept=KEPT_SQL))
def h16_migrated_store(spark, sf_dir):
    """Games of the raw store after a migration was carried out on it."""
    return _migrated(spark, sf_dir, "raw")


@register("h14_backups", MIGRATED_SQL.format(moved="false", kept=f"NOT ({KEPT_SQL})"))
def h14_backups(spark, sf_dir):
    """Games that the same migration dropped, read back from its backups."""
    return _migrated(spark, sf_dir, "backup")


def _entries(headers):
    """A catalogue in the job's schema: the (competition, group) pairs of the
    games with eras of two seasons, each open for a third one."""
    era = F.floor(F.col("season") / 2).cast("int")
    e = headers.select("competition", F.col("grp"), era.alias("era")).distinct()
    return e.select("competition", "grp", F.when(F.col("era") % 2 == 0, "senior").otherwise("youth").alias("category"),
                    (F.col("era") * 2 + 1).alias("valid_from"), (F.col("era") * 2 + 3).alias("valid_to"))


@register("h11_catalogue", W("headers") + """,
e0 AS (SELECT DISTINCT competition, grp, CAST(floor(season / 2) AS INTEGER) AS era FROM hdr),
e1 AS (SELECT competition, grp, CASE WHEN era % 2 = 0 THEN 'senior' ELSE 'youth' END AS category,
              era * 2 + 1 AS valid_from, era * 2 + 3 AS valid_to FROM e0),
e AS (SELECT competition, grp, category, valid_from,
             least(valid_to, coalesce(lead(valid_from) OVER (PARTITION BY competition, grp ORDER BY valid_from) - 1, valid_to)) AS valid_to
      FROM e1)
SELECT h.game_id, h.competition, h.season, h.grp, e.category, e.valid_from, e.valid_to,
       CASE WHEN e.category = 'senior' THEN 'listed' WHEN e.category IS NOT NULL THEN 'other_category' ELSE 'gap' END AS catalogue_status
FROM hdr h LEFT JOIN e ON e.competition = h.competition AND e.grp = h.grp AND h.season BETWEEN e.valid_from AND e.valid_to""")
def h11_catalogue(spark, sf_dir):
    """Every game with the catalogue entry in force in its season."""
    h = D.headers(spark, sf_dir).select("game_id", "competition", "season", "grp")
    return I.in_catalogue(h, _entries(h))


# --- presentation and nested forms ----------------------------------------------


from .sources import lake as LK  # noqa: E402


def _title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
            "lambda t: CASE WHEN regexp_matches(t, '^\\p{L}') THEN upper(t[1]) || lower(t[2:]) ELSE t END), '')")


def _capseg_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '([-''’]|[^-''’]+)', 1), "
            "lambda p: CASE WHEN regexp_matches(p, '^\\p{L}') THEN upper(p[1]) || p[2:] ELSE p END), '')")


@register("f05_display_names", W("lines") + f""",
m AS (SELECT player_name, trim(coalesce(player_name, '')) AS nm FROM (SELECT DISTINCT player_name FROM players))
SELECT player_name, {slug_sql('player_name')} AS slug,
  CASE WHEN nm = '' THEN ''
       WHEN contains(nm, ',') THEN {_title_sql("trim(regexp_replace(nm, '^[^,]*,', ''))")} || ' '
            || {_title_sql("trim(split_part(nm, ',', 1))")}
       ELSE {_title_sql('nm')} END AS display_name
FROM m""")
def f05_display_names(spark, sf_dir):
    p = tables(spark, sf_dir).players
    names = p.select("player_name").distinct()
    return names.select("player_name", T.slug(F.col("player_name")).alias("slug"),
                        T.display_name(F.col("player_name")).alias("display_name"))


@register("f06_team_display_names", W("lines") + f"""
SELECT team, {slug_sql('team')} AS team_key,
  CASE WHEN team IS NULL OR team = '' THEN '' ELSE array_to_string(list_transform(string_split_regex(team, '\\s+'),
    lambda w, i: CASE
      WHEN contains(w, '.') OR (length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) BETWEEN 1 AND 4
           AND NOT regexp_matches(regexp_replace(w, '[^\\p{{L}}]', '', 'g'), '(?i)[aeiouyáéíóúàèìòùäëïöü]')) THEN upper(w)
      WHEN i > 1 AND lower(w) IN ('de', 'del', 'y', 'i', 'da', 'do') THEN lower(w)
      ELSE {_capseg_sql('lower(w)')} END), ' ') END AS display_name
FROM (SELECT DISTINCT team FROM players)""")
def f06_team_display_names(spark, sf_dir):
    p = tables(spark, sf_dir).players
    return p.select("team").distinct().select("team", T.slug(F.col("team")).alias("team_key"),
                                              T.team_display_name(F.col("team")).alias("display_name"))


@register("a14_zone_map", ZONES_SQL + """
SELECT competition, season, player_name, zone, count(*) FILTER (WHERE made = 1) AS made, count(*) AS att,
       count(*) FILTER (WHERE made = 1) / count(*) AS pct
FROM ps GROUP BY competition, season, player_name, zone""")
def a14_zone_map(spark, sf_dir):
    """A14 nested, its map opened again: one row per entry."""
    t = tables(spark, sf_dir)
    z = S.zone_map(t.players, t.shots)
    return z.select("competition", "season", "player_name", F.explode("zones").alias("zone", "v")).select(
        "competition", "season", "player_name", "zone", "v.*")


A20_SQL = EDGES_SQL + f""",
roles AS (
  SELECT competition, season, team, edge_rank, passer AS name, assists AS given, 0 AS received, 0 AS created FROM edges
  UNION ALL
  SELECT competition, season, team, edge_rank, scorer, 0, assists, points FROM edges),
n AS (
  SELECT competition, season, name, min({{'r': edge_rank, 't': team}}).t AS team,
         CAST(sum(given) AS BIGINT) AS assists_given, CAST(sum(received) AS BIGINT) AS assists_received,
         CAST(sum(created) AS BIGINT) AS points_created
  FROM roles GROUP BY competition, season, name)
SELECT competition, season, name, {slug_sql('name')} AS slug, team, assists_given, assists_received, points_created,
  CAST(row_number() OVER (PARTITION BY competition, season
       ORDER BY assists_given + assists_received DESC, name) AS INTEGER) AS node_rank
FROM n"""


@register("j16_induced_nodes", A20_SQL.replace("\nSELECT competition, season, name,", ",\nnodes AS (\nSELECT competition, season, name,", 1)
          + """)
SELECT * FROM nodes n WHERE EXISTS (SELECT 1 FROM edges e WHERE e.edge_rank <= 10
  AND e.competition = n.competition AND e.season = n.season AND (e.passer = n.name OR e.scorer = n.name))""")
def j16_induced_nodes(spark, sf_dir):
    t = tables(spark, sf_dir)
    return PBP.induced_nodes(PBP.assist_edges(t.plays, t.games), k=10)


BRONZE_PLAYER_COLS = """p.game_id, p.competition, p.season, p.grp, p.date, p.home_team, p.away_team, p.is_home, p.team,
  p.jersey, p.player_name, p.minutes, p.points, p.t2m, p.t2a, p.t3m, p.t3a, p.ftm, p.fta, p.orb, p.drb, p.reb,
  p.ast, p.stl, p.blk, p.tov, p.pf, p.plus_minus, p.val"""


HDR_SQL = W("lines", "teams", "shots") + """,
head AS (
  SELECT game_id, competition, season, grp, date, game_date, home_team, away_team,
         CAST(sum(CASE WHEN is_home THEN points END) AS INTEGER) AS home_score,
         CAST(sum(CASE WHEN NOT is_home THEN points END) AS INTEGER) AS away_score
  FROM players GROUP BY ALL)"""


@register("s10_wide_box_score", HDR_SQL + f"""
SELECT {BRONZE_PLAYER_COLS}, '' AS time, '' AS venue, g.home_score, g.away_score,
       CAST(strptime(p.date, '%d/%m/%Y') AS DATE)::VARCHAR AS game_date
FROM players p JOIN head g ON p.game_id = g.game_id""")
def s10_wide_box_score(spark, sf_dir):
    w = LK.wide_box_score(catalog.documents(spark, sf_dir))
    return w.withColumn("game_date", F.col("game_date").cast("string"))


@register("b02_bronze_players_from_documents", W("lines") + f" SELECT {BRONZE_PLAYER_COLS} FROM players p")
def b02_bronze_players_from_documents(spark, sf_dir):
    return lake(spark, sf_dir, "bronze", "players")


@register("b01_bronze_games", HDR_SQL + """
SELECT game_id, competition, season, grp, date, '' AS time, '' AS venue, home_team, away_team, home_score, away_score,
       substr(date, 7, 4) AS calendar_year FROM head""")
def b01_bronze_games(spark, sf_dir):
    return lake(spark, sf_dir, "bronze", "games")


@register("b03_bronze_plays", HDR_SQL + """
SELECT r.game_id, h.competition, h.season, CAST(num AS VARCHAR) AS num, CAST(quarter AS VARCHAR) AS quarter, time, text,
       CAST(team AS VARCHAR) AS team, action, CAST(scoreA AS VARCHAR) AS "scoreA", CAST(scoreB AS VARCHAR) AS "scoreB",
       CAST(player_id AS VARCHAR) AS player_id, CAST(team_id AS VARCHAR) AS team_id
FROM raw_plays r JOIN head h ON r.game_id = h.game_id""")
def b03_bronze_plays(spark, sf_dir):
    return lake(spark, sf_dir, "bronze", "plays")


@register("b04_bronze_shots", HDR_SQL + """
SELECT s.game_id, h.competition, h.season, CAST(quarter AS VARCHAR) AS quarter, time, CAST(player AS VARCHAR) AS player,
       CAST(team AS VARCHAR) AS team, CAST(made AS VARCHAR) AS made, CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y
FROM shots1 s JOIN head h ON s.game_id = h.game_id""")
def b04_bronze_shots(spark, sf_dir):
    return lake(spark, sf_dir, "bronze", "shots")


TEAM_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in (
    "team_id", "points", "t2m", "t2a", "t3m", "t3a", "ftm", "fta", "off_reb", "def_reb", "tot_reb", "ast", "stl", "tov",
    "blk", "pf"))


@register("b05_bronze_teams", W("teams") + f" SELECT game_id, competition, season, is_home, team_name, {TEAM_TEXT} FROM teams")
def b05_bronze_teams(spark, sf_dir):
    return lake(spark, sf_dir, "bronze", "teams")


@register("b07_silver_games", HDR_SQL + """
SELECT game_id, competition, season, grp, date, '' AS time, '' AS venue, home_team, away_team, home_score, away_score,
       substr(date, 7, 4) AS calendar_year, game_date::VARCHAR AS game_date FROM head""")
def b07_silver_games(spark, sf_dir):
    return lake(spark, sf_dir, "silver", "games").withColumn("game_date", F.col("game_date").cast("string"))


META_SQL = """h.game_id, h.date, '' AS time, '' AS venue, h.home_team, h.away_team, h.home_score, h.away_score,
  '' AS scraped_at, 'driver' AS source, h.competition, h.season AS year, h.grp"""


@register("s11_wide_plays", HDR_SQL + f"""
SELECT {META_SQL}, CAST(num AS VARCHAR) AS num, CAST(quarter AS VARCHAR) AS quarter, r.time AS line_time, text,
       CAST(team AS VARCHAR) AS team, action, CAST(scoreA AS VARCHAR) AS "scoreA", CAST(scoreB AS VARCHAR) AS "scoreB",
       CAST(player_id AS VARCHAR) AS "idPlayer", CAST(team_id AS VARCHAR) AS "idTeam"
FROM raw_plays r JOIN head h ON r.game_id = h.game_id""")
def s11_wide_plays(spark, sf_dir):
    return LK.wide_lines(catalog.documents(spark, sf_dir), "plays")


@register("s11_wide_shots", HDR_SQL + f"""
SELECT {META_SQL}, CAST(quarter AS VARCHAR) AS quarter, s.time AS t, CAST(player AS VARCHAR) AS player,
       CAST(team AS VARCHAR) AS team, CAST(made AS VARCHAR) AS m, CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y
FROM shots1 s JOIN head h ON s.game_id = h.game_id""")
def s11_wide_shots(spark, sf_dir):
    return LK.wide_lines(catalog.documents(spark, sf_dir), "shots")


TEAM_KEYS = {"id": "team_id", "pts": "points", "p2m": "t2m", "p2a": "t2a", "p3m": "t3m", "p3a": "t3a", "p1m": "ftm",
             "p1a": "fta", "ro": "off_reb", "rd": "def_reb", "rt": "tot_reb", "assist": "ast", "st": "stl", "to": "tov",
             "bs": "blk", "pf": "pf"}


@register("s11_wide_team_lines", HDR_SQL + f"""
SELECT {META_SQL}, team_name AS name, {", ".join(f'CAST(t.{c} AS VARCHAR) AS "{k}"' for k, c in TEAM_KEYS.items())}
FROM teams t JOIN head h ON t.game_id = h.game_id""")
def s11_wide_team_lines(spark, sf_dir):
    return LK.wide_lines(catalog.documents(spark, sf_dir), "teams")


@register("s13_inventory", W("lines") + """
SELECT competition, season AS year, grp AS "group", count(DISTINCT game_id) AS games FROM players GROUP BY ALL""")
def s13_inventory(spark, sf_dir):
    """S13 over the written raw store."""
    return LK.inventory(spark, catalog.raw_root(spark, sf_dir)).drop("documents")


@register("s02_updated_silver_players", catalog.ORACLE["b06_silver_players"])
def s02_updated_silver_players(spark, sf_dir):
    """Silver players of the lake that the ledger brought up to date."""
    root = catalog.updated_lake(spark, sf_dir)
    return LK.read_table(spark, f"{root}/lake", "silver", "players").select(*SILVER_PLAYER_COLS)


@register("s02_updated_fact_games", catalog.ORACLE["b13_fact_games"])
def s02_updated_fact_games(spark, sf_dir):
    """The games of the lake that the ledger brought up to date."""
    root = catalog.updated_lake(spark, sf_dir)
    return LK.read_table(spark, f"{root}/lake", "gold", "fact_games").drop("game_date")


@register("s13_ledger_changes", W("lines") + """,
p AS (SELECT DISTINCT competition, season FROM players),
o AS (SELECT '9-OLD' AS competition, season FROM p WHERE competition = '5-LOW')
SELECT competition, season, competition IN ('5-LOW', '9-OLD') AS stale, competition = '5-LOW' AS has_new,
       competition = '9-OLD' AS has_gone, competition NOT IN ('5-LOW', '9-OLD') AS has_same
FROM (SELECT * FROM p UNION ALL SELECT * FROM o)""")
def s13_ledger_changes(spark, sf_dir):
    """Partitions whose raw files changed since the lake was built."""
    d = spark.read.parquet(f"{catalog.updated_lake(spark, sf_dir)}/changes")
    return d.select("competition", "season", "stale", *[(F.col(c) > 0).alias(f"has_{c}") for c in ("new", "gone", "same")])


# The serving tables, read back from the lake, types as declared.
from .sources.schema import SERVING  # noqa: E402

DUCK = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "boolean": "BOOLEAN",
        "float": "FLOAT", "double": "DOUBLE", "date": "DATE"}
SERVING_FROM = {
    "games": "(SELECT *, home_score + away_score AS total_points, CASE WHEN home_score > away_score THEN 'home' "
             "WHEN home_score < away_score THEN 'away' ELSE 'draw' END AS winner FROM games)",
    "players": "players",
    "plays": "(SELECT p.*, h.competition, h.season FROM plays p JOIN head h ON p.game_id = h.game_id)",
    "shots": "(SELECT s.*, h.competition, h.season FROM fshots s JOIN head h ON s.game_id = h.game_id)",
    "teams": "teams",
}


def _serving(name):
    columns, zero, _ = SERVING[name]
    cols = ", ".join((f"CAST(coalesce({c}, 0) AS {DUCK[t]})" if c in zero else f"CAST({c} AS {DUCK[t]})") + f' AS "{c}"'
                     for c, t in columns.items()).replace("CAST(game_date AS DATE)", "CAST(game_date AS VARCHAR)")
    games = W("games", "teams", "shots") + HDR_SQL[len(W("lines", "teams", "shots")):]

    @register(f"b16_serving_{name}", games + f" SELECT {cols} FROM {SERVING_FROM[name]}")
    def query(spark, sf_dir):
        d = lake(spark, sf_dir, "serving", name)
        return d.withColumn("game_date", F.col("game_date").cast("string")) if "game_date" in columns else d


for _name in SERVING:
    _serving(_name)


# Questions over one season of the lake (its folders only are read).
@register("p08_clutch_one_season", SCORED_SQL.replace("clutch AS (", "clutch0 AS (") + """,
clutch AS (SELECT * FROM clutch0 WHERE season = 1995)
SELECT competition, season, player_name, count(DISTINCT game_id) AS games, count(*) FILTER (WHERE action = 'shoot') AS fga
FROM clutch GROUP BY competition, season, player_name""")
def p08_clutch_one_season(spark, sf_dir):
    t = catalog.lake_tables(spark, sf_dir, "plays", "games")
    return PBP.clutch(t.plays, t.games, Context(season=1995), min_games=1).select(
        "competition", "season", "player_name", "games", "fga")


@register("p08_standings_one_context", STANDINGS_SQL.rstrip() + " WHERE competition = '1-URGENT' AND season = 1996")
def p08_standings_one_context(spark, sf_dir):
    return league.standings(catalog.lake_tables(spark, sf_dir, "games").games, Context("1-URGENT", 1996))


@register("j14_team_standing", f"SELECT * FROM ({STANDINGS_SQL}) WHERE team_key = 'cb-almenara'")
def j14_team_standing(spark, sf_dir):
    """One team's row of every standings table."""
    return S.team_sheet(tables(spark, sf_dir), slug="cb-almenara")["standing"]


@register("p16_team_assist_edges", EDGES_SQL.replace("edges AS (", "edges0 AS (").replace(
    "FROM e)", "FROM e WHERE team = 'CB ALMENARA')") + " SELECT * FROM edges0")
def p16_team_assist_edges(spark, sf_dir):
    """The network of one team, by its slug."""
    t = tables(spark, sf_dir)
    return PBP.assist_edges(t.plays, t.games, team_slug="cb-almenara")


@register("f07_group_labels", W("headers") + """
SELECT DISTINCT team AS name, regexp_replace(regexp_replace(regexp_replace(strip_accents(team), '[^\\x00-\\x7F]', '', 'g'),
       '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS label
FROM (SELECT home_team AS team FROM hdr UNION ALL SELECT away_team FROM hdr)""")
def f07_group_labels(spark, sf_dir):
    """F07 on group names of the source's form, one per team."""
    h = D.headers(spark, sf_dir)
    names = h.select(F.explode(F.array("home_team", "away_team")).alias("name")).distinct()
    return names.select("name", T.group_slug(F.concat(F.lit('Liga Regular "'), F.col("name"), F.lit('"'))).alias("label"))


@register("f24_half_court", W("shots") + """
SELECT game_id, quarter, time, player, x, y, y * CAST(0.15 AS DOUBLE) * 100 AS cx,
       1400.0::DOUBLE - (CASE WHEN x < 50 THEN x ELSE 100 - x END) * CAST(0.28 AS DOUBLE) * 100 AS cy FROM fshots""")
def f24_half_court(spark, sf_dir):
    s = tables(spark, sf_dir).shots
    return s.select("game_id", "quarter", "time", "player", "x", "y", X.half_court("x", "y").alias("c")).select("*", "c.*").drop("c")


# --- ad-hoc SQL over the serving tables, presentation --------------------------

from .catalog import ORACLE as ORACLE_OF  # noqa: E402
from .plans import marts as MARTS, nested as NESTED  # noqa: E402
from .plans import present as PR  # noqa: E402


def _views(spark, sf_dir):
    t = tables(spark, sf_dir)
    for name in ("games", "players", "plays", "shots", "teams"):
        getattr(t, name).createOrReplaceTempView(f"cs_{name}")


@register("s16_sql_top_rating", W("lines") + """
SELECT * FROM (
  SELECT competition, season, game_id, player_name, team, val,
         CAST(row_number() OVER (PARTITION BY competition, season, game_id
              ORDER BY val DESC, player_name) AS INTEGER) AS position
  FROM players) WHERE position <= 5""")
def s16_sql_top_rating(spark, sf_dir):
    """Top 5 by rating in every game, as SQL over temp views."""
    _views(spark, sf_dir)
    return spark.sql("""
      SELECT * FROM (
        SELECT competition, season, game_id, player_name, team, val,
               row_number() OVER (PARTITION BY competition, season, game_id
                                  ORDER BY val DESC, player_name) AS position
        FROM cs_players) WHERE position <= 5""")


@register("s16_sql_team_shooting", W("teams") + """
SELECT competition, season, team_name, CAST(sum(t2m + t3m) AS BIGINT) AS fgm, CAST(sum(t2a + t3a) AS BIGINT) AS fga,
       CASE WHEN sum(t2a + t3a) > 0 THEN CAST(sum(t2m + t3m) AS DOUBLE) / sum(t2a + t3a) END AS fg_pct
FROM teams GROUP BY competition, season, team_name""")
def s16_sql_team_shooting(spark, sf_dir):
    """Per-team shooting, as SQL over temp views."""
    _views(spark, sf_dir)
    return spark.sql("""
      SELECT competition, season, team_name, sum(t2m + t3m) AS fgm, sum(t2a + t3a) AS fga,
             CASE WHEN sum(t2a + t3a) > 0
                  THEN CAST(sum(t2m + t3m) AS DOUBLE) / sum(t2a + t3a) END AS fg_pct
      FROM cs_teams GROUP BY competition, season, team_name""")


@register("s16_sql_game_summary", W("games") + """
SELECT competition, season, count(*) AS games, CAST(sum(home_score + away_score) AS BIGINT) AS points,
       count(*) FILTER (WHERE home_score > away_score) AS home_wins
FROM games GROUP BY competition, season""")
def s16_sql_game_summary(spark, sf_dir):
    """Game summary per context, as SQL over temp views."""
    _views(spark, sf_dir)
    return spark.sql("""
      SELECT competition, season, count(*) AS games, sum(home_score + away_score) AS points,
             count_if(home_score > away_score) AS home_wins
      FROM cs_games GROUP BY competition, season""")


@register("t02_leaders_page2", W("lines") + f""",
agg AS ({LEADER_BODY.format(where='')}),
pool AS (SELECT {LEADER_COLS} FROM agg WHERE games >= 6 AND avg_min >= 15)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY competition, season
              ORDER BY avg_val DESC, player_name) AS INTEGER) AS position FROM pool)
WHERE position > 10 AND position <= 20""")
def t02_leaders_page2(spark, sf_dir):
    """Second page of 10 leaders per context (offset 10)."""
    return league.leaders(tables(spark, sf_dir).players, limit=10, offset=10)


LEADERS_PAGE_SQL = ORACLE_OF["a11_leaders"]
LEADER_DOUBLES = {c: 1 for c in ("avg_min", "avg_pts", "avg_reb", "avg_ast", "avg_stl", "avg_blk", "avg_to", "avg_val",
                                 "avg_plus_minus")} | {c: 4 for c in ("t2_pct", "t3_pct", "ft_pct", "fg_pct", "efg_pct", "ts_pct")}


@register("f29_leaders_presented", "SELECT * REPLACE (" + ", ".join(
    f"round({c}, {n}) AS {c}" for c, n in LEADER_DOUBLES.items()) + f") FROM ({LEADERS_PAGE_SQL})")
def f29_leaders_presented(spark, sf_dir):
    """the leaders page rounded for display."""
    return PR.present(league.leaders(tables(spark, sf_dir).players))


@register("f30_player_sheet_json", ORACLE_OF["a13_player_sheet"])
def f30_player_sheet_json(spark, sf_dir):
    """player sheets as one JSON answer per player, opened again."""
    sheet = S.player_sheet(tables(spark, sf_dir).players)
    keys = ["competition", "season", "slug"]
    return PR.as_json(sheet, keys).select(*keys, F.from_json("answer", sheet.drop(*keys).schema).alias("a")).select(
        *keys, "a.*")


def _flat(d, keys, child):
    """Rows of one list of the answers, all parts."""
    return d.select(*keys, F.explode(child).alias("x")).select(*keys, "x.*")


@register("f30_player_answer_log", ORACLE_OF["j06_game_log"])
def f30_player_answer_log(spark, sf_dir):
    """the game logs inside the nested player answers."""
    return _flat(catalog.answers(spark, sf_dir, "players"), NESTED.PLAYER, "game_log")


@register("f30_player_answer_shots", ORACLE_OF["j07_player_shots"])
def f30_player_answer_shots(spark, sf_dir):
    """the shots inside the nested player answers."""
    return _flat(catalog.answers(spark, sf_dir, "players"), NESTED.PLAYER, "shots")


@register("f30_player_answer_fields", ORACLE_OF["a13_player_sheet"])
def f30_player_answer_fields(spark, sf_dir):
    """the answers' own fields (of every player's first part), opened again."""
    d = catalog.answers(spark, sf_dir, "players").where("part = 0")
    fields = [F.col(f"{part}.{c}").alias(prefix + c) for part, (prefix, cols) in MARTS.PARTS.items() for c in cols]
    shooting = [F.col(f"shooting.{c}").alias(f"{c}_pct") for c in MARTS.SHOOTING]
    columns = S.player_sheet(tables(spark, sf_dir).players).columns
    found = d.select(*NESTED.PLAYER, "slug", "team", "grp", "jersey", "games", *fields, *shooting,
                     F.col("per_game.plus_minus").alias("avg_plus_minus"))
    return found.select(*columns)


@register("f30_team_answer_log", ORACLE_OF["j08_pace_log"])
def f30_team_answer_log(spark, sf_dir):
    """the game logs inside the nested team answers."""
    return _flat(catalog.answers(spark, sf_dir, "teams"), NESTED.TEAM, "game_log")


@register("s15_snapshot_log", ORACLE_OF["j06_game_log"])
def s15_snapshot_log(spark, sf_dir):
    """The game logs of the published snapshot, read back from its JSON."""
    return _flat(catalog.answers(spark, sf_dir, "players", published=True), NESTED.PLAYER, "game_log")


QUALITY_SQL = W("games", "teams", "shots") + """,
sides AS (SELECT competition, season, home_team AS team, home_score AS pf, away_score AS pa FROM games
          UNION ALL SELECT competition, season, away_team, away_score, home_score FROM games),
st AS (SELECT competition, season, team, count(*) AS games, count(*) FILTER (WHERE pf > pa) AS wins,
         count(*) FILTER (WHERE pf <= pa) AS not_won FROM sides GROUP BY ALL),
ps AS (SELECT p.competition, p.season, p.player_name, s.zone, s.made
       FROM players p JOIN fshots s ON p.game_id = s.game_id AND p.jersey = s.player
        AND s.team = CASE WHEN p.is_home THEN 0 ELSE 1 END),
zs AS (SELECT competition, season, player_name, sum(n) AS z FROM
         (SELECT competition, season, player_name, zone, count(*) AS n FROM ps WHERE zone IS NOT NULL GROUP BY ALL) GROUP BY ALL),
sc AS (SELECT game_id, team, player, count(*) AS n FROM fshots GROUP BY ALL),
ns AS (SELECT p.competition, p.season, p.player_name, sum(sc.n) AS n
       FROM (SELECT DISTINCT competition, season, game_id, player_name, jersey, is_home FROM players) p
       JOIN sc ON p.game_id = sc.game_id AND p.jersey = sc.player AND sc.team = CASE WHEN p.is_home THEN 0 ELSE 1 END
       GROUP BY ALL),
summ AS (SELECT competition, season, count(DISTINCT team) AS teams FROM players
         WHERE (competition, season) IN (SELECT competition, season FROM games) GROUP BY ALL),
stc AS (SELECT competition, season, count(*) AS st FROM st GROUP BY ALL),
days AS (SELECT competition, season, count(*) AS n FROM games g JOIN
           (SELECT DISTINCT competition AS c, season AS s, game_date AS d FROM games) x
           ON g.competition = x.c AND g.season = x.s AND g.game_date = x.d GROUP BY ALL),
gm AS (SELECT competition, season, count(*) AS m FROM games GROUP BY ALL),
rated AS (SELECT *, CASE WHEN fga > 0 THEN round((fgm + 0.5::DOUBLE * t3m) / fga, 9) END AS efg,
                 CASE WHEN fga + fta > 0 THEN round(points / (2 * (fga + 0.44::DOUBLE * fta)), 9) END AS ts,
                 CASE WHEN t2a > 0 THEN t2m / t2a END AS t2, CASE WHEN t3a > 0 THEN t3m / t3a END AS t3,
                 CASE WHEN fta > 0 THEN ftm / fta END AS ft FROM players),
lead2 AS (SELECT competition, season, player_name, row_number() OVER (PARTITION BY competition, season
            ORDER BY avg(val) DESC, player_name) AS position FROM players GROUP BY competition, season, player_name
          HAVING count(*) >= 6 AND avg(minutes) >= 15),
foulgames AS (SELECT g.competition, g.season, p.player_name, p.game_id, count(*) AS fouls,
                count(*) FILTER (WHERE foul_type = 'personal') AS pers, count(*) FILTER (WHERE foul_type = 'technical') AS tech,
                count(*) FILTER (WHERE foul_type = 'disqualifying') AS disq
              FROM plays p JOIN games g ON p.game_id = g.game_id
              WHERE p.action = 'foul' AND p.player_name IS NOT NULL GROUP BY ALL),
played AS (SELECT competition, season, player_name, count(*) AS games FROM players GROUP BY ALL),
foulrows AS (SELECT f.competition, f.season, f.player_name, sum(fouls) AS fouls, sum(pers + tech + disq) AS total,
               count(*) FILTER (WHERE pers >= 5) AS out_games, any_value(p.games) AS games
             FROM foulgames f JOIN played p ON p.competition = f.competition AND p.season = f.season
              AND p.player_name = f.player_name GROUP BY f.competition, f.season, f.player_name HAVING any_value(p.games) >= 3),
tb AS (SELECT game_id, sum(CASE WHEN is_home THEN points END) AS h, sum(CASE WHEN NOT is_home THEN points END) AS a
       FROM teams GROUP BY game_id)
SELECT 'q01_team_missing_or_wrong_side' AS rule,
       count(*) FILTER (WHERE team IS NULL OR team <> CASE WHEN is_home THEN home_team ELSE away_team END) AS violations
FROM players
UNION ALL SELECT 'q03_efg_formula', count(*) FILTER (WHERE efg IS DISTINCT FROM
  CASE WHEN t2a + t3a > 0 THEN round((t2m + 1.5::DOUBLE * t3m) / (t2a + t3a), 9) END) FROM rated
UNION ALL SELECT 'q03_ts_formula', count(*) FILTER (WHERE ts IS DISTINCT FROM
  CASE WHEN t2a + t3a + fta > 0 THEN round((2 * t2m + 3 * t3m + ftm) / (2 * (t2a + t3a) + 0.88::DOUBLE * fta), 9) END) FROM rated
UNION ALL SELECT 'q03_pct_without_attempts', count(*) FILTER (WHERE (t2 IS NULL) <> (t2a = 0) OR (t3 IS NULL) <> (t3a = 0)
  OR (ft IS NULL) <> (fta = 0)) FROM rated
UNION ALL SELECT 'q04_game_in_two_contexts', count(*) FROM
  (SELECT game_id FROM players GROUP BY game_id HAVING count(DISTINCT (competition, season)) > 1)
UNION ALL SELECT 'q05_score_vs_team_box', count(*) FROM games g LEFT JOIN tb ON g.game_id = tb.game_id
  WHERE g.home_score IS DISTINCT FROM tb.h OR g.away_score IS DISTINCT FROM tb.a
UNION ALL SELECT 'q06_zone_distance_points', count(*) FILTER (WHERE zone NOT IN ('rim', 'mid', 'three')
  OR shot_distance_m > 28 OR (made = 1 AND is_three AND shot_points <> 3)) FROM fshots
UNION ALL SELECT 'q07_zone_attempts_vs_shots', count(*) FROM zs FULL JOIN ns
  ON zs.competition = ns.competition AND zs.season = ns.season AND zs.player_name = ns.player_name
  WHERE zs.z IS DISTINCT FROM ns.n
UNION ALL SELECT 'q08_games_vs_wins_losses', count(*) FILTER (WHERE games IS DISTINCT FROM wins + not_won) FROM st
UNION ALL SELECT 'q08_standing_teams_vs_summary', count(*) FROM stc FULL JOIN
  (SELECT g.competition, g.season, coalesce(s.teams, 0) AS teams FROM gm g LEFT JOIN summ s
     ON g.competition = s.competition AND g.season = s.season) sm
  ON stc.competition = sm.competition AND stc.season = sm.season WHERE stc.st IS DISTINCT FROM sm.teams
UNION ALL SELECT 'q09_context_mixed', count(*) FROM
  (SELECT DISTINCT game_id, competition, season FROM players) p JOIN games g ON p.game_id = g.game_id
  WHERE p.competition <> g.competition OR p.season <> g.season
UNION ALL SELECT 'q11_makes_over_attempts', count(*) FILTER (WHERE t2m > t2a OR t3m > t3a OR ftm > fta) FROM players
UNION ALL SELECT 'q11_self_assist', count(*) FILTER (WHERE assisted_by_name = player_name) FROM plays
UNION ALL SELECT 'q12_match_days_lose_games', count(*) FROM days FULL JOIN gm
  ON days.competition = gm.competition AND days.season = gm.season WHERE days.n IS DISTINCT FROM gm.m
UNION ALL SELECT 'q12_shot_outside_canvas', count(*) FILTER (WHERE
    y * CAST(0.15 AS DOUBLE) * 100 < -1e-6 OR y * CAST(0.15 AS DOUBLE) * 100 > 1500 + 1e-6
    OR 1400.0 - (CASE WHEN x < 50 THEN x ELSE 100 - x END) * CAST(0.28 AS DOUBLE) * 100 < -1e-6
    OR 1400.0 - (CASE WHEN x < 50 THEN x ELSE 100 - x END) * CAST(0.28 AS DOUBLE) * 100 > 1400 + 1e-6) FROM fshots
UNION ALL SELECT 'q13_unresolved_player_names', count(*) FILTER (WHERE player_id IS NOT NULL AND player_name IS NULL)
  FROM plays
UNION ALL SELECT 'q02_required_values', (SELECT count(*) FROM players WHERE game_id IS NULL OR player_name IS NULL OR team IS NULL
    OR is_home IS NULL OR minutes IS NULL OR points IS NULL OR t2m IS NULL OR t2a IS NULL OR t3m IS NULL OR t3a IS NULL
    OR ftm IS NULL OR fta IS NULL OR reb IS NULL OR ast IS NULL OR stl IS NULL OR blk IS NULL OR tov IS NULL OR pf IS NULL
    OR val IS NULL)
  + (SELECT count(*) FROM games WHERE game_id IS NULL OR competition IS NULL OR season IS NULL OR home_team IS NULL
    OR away_team IS NULL OR home_score IS NULL OR away_score IS NULL)
UNION ALL SELECT 'q09_group_does_not_shrink', count(*) FROM (
  SELECT a.n, b.whole, b.groups FROM
    (SELECT competition, season, grp, count(DISTINCT game_id) AS n FROM games GROUP BY ALL) a JOIN
    (SELECT competition, season, count(DISTINCT game_id) AS whole, count(DISTINCT grp) AS groups FROM games GROUP BY ALL) b
    ON a.competition = b.competition AND a.season = b.season) WHERE groups > 1 AND n >= whole
UNION ALL SELECT 'q10_pages_overlap', count(*) FROM (
  SELECT competition, season, player_name FROM lead2 WHERE position BETWEEN 1 AND 20
  GROUP BY competition, season, player_name HAVING count(*) > 1)
UNION ALL SELECT 'q11_foul_types_and_games', count(*) FROM foulrows WHERE total <> fouls OR out_games > games
UNION ALL SELECT 'q12_match_day_mixes_dates', count(*) FROM (
  SELECT competition, season, match_day FROM (
    SELECT competition, season, game_date, dense_rank() OVER (PARTITION BY competition, season ORDER BY game_date DESC) AS match_day
    FROM games) GROUP BY ALL HAVING count(DISTINCT game_date) > 1)"""
from .catalog import ORACLE  # noqa: E402
ORACLE["q00_quality"] = QUALITY_SQL


# --- incremental load (Structured Streaming) ------------------------------------

from .streaming import incremental as INC  # noqa: E402


@register("s01_stream_bronze_players", W("lines") + f" SELECT {BRONZE_PLAYER_COLS} FROM players p")
def s01_stream_bronze_players(spark, sf_dir):
    """S01/S12 + streaming: the written raw store picked up by the file
    stream (availableNow), turned into bronze player rows per micro-batch;
    the answer is the latest delivery of every game."""
    import uuid

    from .session import checkpoint_dir
    root = f"{checkpoint_dir(spark)}/courtside-stream/{uuid.uuid4().hex[:12]}"
    q = INC.load_bronze(spark, catalog.raw_root(spark, sf_dir), f"{root}/bronze", f"{root}/checkpoint", once=True)
    q.awaitTermination()
    return INC.read_bronze(spark, f"{root}/bronze", "players").drop("batch")


# --- joins without a shuffle ---------------------------------------------------

@register("j09_bucketed_assist_edges", ORACLE_OF["a19_assist_edges"])
def j09_bucketed_assist_edges(spark, sf_dir):
    """Assist edges over plays and games bucketed by game."""
    c = catalog.colocated(spark, sf_dir)
    return PBP.assist_edges(c.plays, c.games)


@register("j10_bucketed_player_fouls", ORACLE_OF["a21_player_fouls"])
def j10_bucketed_player_fouls(spark, sf_dir):
    """Fouls over plays, games and players bucketed by game."""
    c = catalog.colocated(spark, sf_dir)
    return PBP.player_fouls(c.plays, c.games, c.players)


@register("j06_bucketed_game_log", ORACLE_OF["j06_game_log"])
def j06_bucketed_game_log(spark, sf_dir):
    """Game logs over players and games bucketed by game."""
    c = catalog.colocated(spark, sf_dir)
    return S.game_log(c.players, c.games)


# --- search by index -------------------------------------------------------------

@register("p14_indexed_search", ORACLE_OF["p14_search"])
def p14_indexed_search(spark, sf_dir):
    """The search answered by the inverted index of names."""
    pool = C.leader_pool(tables(spark, sf_dir).players)
    return NX.search(pool, catalog.name_index(spark, sf_dir), SEARCH_TEXT)


@register("p14_index_names", W("lines") + f""",
n AS (SELECT coalesce(player_name, '') AS name FROM players UNION SELECT coalesce(team, '') FROM players),
k AS (SELECT DISTINCT {_fold_sql('name')} AS key FROM n),
g AS (SELECT DISTINCT key, substr(key, CAST(i AS BIGINT), CAST(s AS BIGINT)) AS gram
      FROM k, LATERAL (SELECT unnest(range(1, length(key) + 1)) AS i), (SELECT unnest([1, 2, 3]) AS s)
      WHERE i + s - 1 <= length(key))
SELECT gram, count(*) AS keys, min(key) AS first_key, max(key) AS last_key FROM g GROUP BY gram""")
def p14_index_names(spark, sf_dir):
    """The index itself: how many different names hold each part."""
    grams = lake_read(spark, catalog.name_index(spark, sf_dir), NX.LAYER, "grams")
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("keys"), F.min("key").alias("first_key"),
                                     F.max("key").alias("last_key"))

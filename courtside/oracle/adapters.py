"""The driver adapters restated in plain SQL (DuckDB dialect), for the
side-by-side correctness check. One CTE per layer; questions append their
own SELECT. Mirrors ``courtside.sources.driver`` and the silver/gold
builders step by step.
"""
from __future__ import annotations

from ..sources.driver import GIVEN_NAMES, SLOT_SURNAMES, TEAM_NAMES, TEAM_SURNAMES


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


HEADERS = f"""
hdr0 AS (
  SELECT o_orderkey AS game_id, o_orderpriority AS competition, o_orderstatus AS grp,
         CAST(o_orderdate AS DATE) AS game_date,
         CAST(o_custkey % 24 AS INTEGER) AS home_idx,
         CAST((o_custkey + 1 + o_orderkey % 23) % 24 AS INTEGER) AS away_idx
  FROM orders),
hdr AS (
  SELECT game_id, competition, grp, game_date,
         CAST(year(game_date) - CASE WHEN month(game_date) < 9 THEN 1 ELSE 0 END AS INTEGER) AS season,
         strftime(game_date, '%d/%m/%Y') AS date, home_idx, away_idx,
         {_list(TEAM_NAMES)}[home_idx + 1] AS home_team,
         {_list(TEAM_NAMES)}[away_idx + 1] AS away_team
  FROM hdr0)"""

LINES = f"""
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                              ORDER BY l_partkey, l_suppkey, l_quantity) AS rn
    FROM lineitem) WHERE rn = 1),
ln0 AS (
  SELECT h.*, li.*, (l_linenumber % 2 = 1) AS is_home,
         CAST(CASE WHEN l_linenumber % 2 = 1 THEN home_idx ELSE away_idx END AS INTEGER) AS team_id,
         CAST(l_suppkey % 12 AS INTEGER) AS slot
  FROM li JOIN hdr h ON li.l_orderkey = h.game_id),
ln1 AS (
  SELECT game_id, competition, season, grp, date, game_date, home_team, away_team,
         CAST(l_linenumber AS INTEGER) AS line, is_home, team_id,
         CASE WHEN is_home THEN home_team ELSE away_team END AS team,
         CAST(team_id * 12 + slot AS INTEGER) AS player_id,
         CAST(slot + 4 AS INTEGER) AS jersey,
         {_list(SLOT_SURNAMES)}[slot + 1] || ' ' || {_list(TEAM_SURNAMES)}[team_id + 1] AS surnames,
         {_list(GIVEN_NAMES)}[(slot + team_id) % 7 + 1] AS given,
         CAST(CAST(l_quantity AS INTEGER) % 41 AS DOUBLE) AS minutes,
         CAST(least(l_partkey % 12, l_suppkey % 7) AS INTEGER) AS t2m,
         CAST(l_partkey % 12 AS INTEGER) AS t2a,
         CAST(least(l_partkey % 7, l_orderkey % 4) AS INTEGER) AS t3m,
         CAST(l_partkey % 7 AS INTEGER) AS t3a,
         CAST(least(l_suppkey % 9, l_partkey % 6) AS INTEGER) AS ftm,
         CAST(l_suppkey % 9 AS INTEGER) AS fta,
         CAST(l_orderkey % 4 AS INTEGER) AS orb, CAST(l_partkey % 8 AS INTEGER) AS drb,
         CAST(l_suppkey % 8 AS INTEGER) AS ast, CAST((l_partkey + l_suppkey) % 4 AS INTEGER) AS stl,
         CAST((l_orderkey + l_linenumber) % 3 AS INTEGER) AS blk,
         CAST((l_partkey + l_orderkey) % 5 AS INTEGER) AS tov,
         CAST((l_suppkey + l_linenumber) % 6 AS INTEGER) AS pf,
         CAST(l_orderkey % 21 - 10 AS INTEGER) AS plus_minus
  FROM ln0),
lines AS (
  SELECT *, surnames || ', ' || given AS player_name, orb + drb AS reb,
         2 * t2m + 3 * t3m + ftm AS points,
         2 * t2m + 3 * t3m + ftm + orb + drb + ast + stl + blk - (t2a - t2m) - (t3a - t3m)
           - (fta - ftm) - tov - pf AS val
  FROM ln1),
players AS (
  SELECT *, t2m + t3m AS fgm, t2a + t3a AS fga FROM (
    SELECT *, row_number() OVER (PARTITION BY game_id, player_name, jersey ORDER BY line) AS rn_p
    FROM lines) WHERE rn_p = 1)"""

GAMES = """
games AS (
  SELECT game_id, competition, season, grp, date, game_date, home_team, away_team,
         CAST(sum(CASE WHEN is_home THEN points END) AS INTEGER) AS home_score,
         CAST(sum(CASE WHEN NOT is_home THEN points END) AS INTEGER) AS away_score
  FROM players
  GROUP BY game_id, competition, season, grp, date, game_date, home_team, away_team
  HAVING count(CASE WHEN is_home THEN 1 END) > 0 AND count(CASE WHEN NOT is_home THEN 1 END) > 0)"""

TEAMS = """
teams AS (
  SELECT game_id, competition, season, is_home, team_id, team AS team_name,
         CAST(sum(points) AS INTEGER) AS points, CAST(sum(t2m) AS INTEGER) AS t2m,
         CAST(sum(t2a) AS INTEGER) AS t2a, CAST(sum(t3m) AS INTEGER) AS t3m,
         CAST(sum(t3a) AS INTEGER) AS t3a, CAST(sum(ftm) AS INTEGER) AS ftm,
         CAST(sum(fta) AS INTEGER) AS fta, CAST(sum(ast) AS INTEGER) AS ast,
         CAST(sum(stl) AS INTEGER) AS stl, CAST(sum(tov) AS INTEGER) AS tov,
         CAST(sum(blk) AS INTEGER) AS blk, CAST(sum(pf) AS INTEGER) AS pf,
         CAST(sum(orb) AS INTEGER) AS off_reb, CAST(sum(drb) AS INTEGER) AS def_reb,
         CAST(sum(reb) AS INTEGER) AS tot_reb
  FROM players GROUP BY game_id, competition, season, is_home, team_id, team)"""

PLAYS = r"""
ev0 AS (
  SELECT user_id AS game_id, event_id, ts, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS num,
         count(*) OVER (PARTITION BY user_id) AS n_plays
  FROM events),
ev1 AS (
  SELECT *, CASE WHEN game_id % 5 = 0 THEN 5 ELSE 4 END AS periods,
         floor((num - 1) / 2) AS pair FROM ev0),
ev2 AS (
  SELECT *, CAST(floor(pair * 2 * periods * 600 / n_plays) AS INTEGER) AS t FROM ev1),
ev3 AS (
  SELECT game_id, event_id, num,
         CAST(floor(t / 600) + 1 AS INTEGER) AS quarter,
         printf('%02d:%02d', CAST(floor((600 - t % 600) / 60) AS INTEGER), CAST((600 - t % 600) % 60 AS INTEGER)) AS time,
         CASE WHEN (pair + game_id) % 2 = 0 THEN 1 ELSE 2 END AS team,
         CAST(CASE WHEN (pair + game_id) % 2 = 0 THEN 1 + 2 * (event_id % 4)
                   ELSE 2 + 2 * (event_id % 3) END AS INTEGER) AS line,
         CASE event_type WHEN 'click' THEN 'shoot' WHEN 'purchase' THEN 'fthrow'
              WHEN 'view' THEN 'assist'
              WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'lose' ELSE 'foul' END
              WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'recovery'
                                      WHEN event_id % 4 = 1 THEN 'blockshot' ELSE 'subst' END
         END AS action
  FROM ev2),
ev4 AS (
  SELECT e.*, b.player_id, b.team_id,
         substr(b.given, 1, 1) || '. ' || b.surnames AS label,
         CASE WHEN action = 'shoot' THEN event_id % 5 < 2
              WHEN action = 'fthrow' THEN event_id % 4 <> 0 END AS made_b,
         CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS value
  FROM ev3 e LEFT JOIN lines b ON e.game_id = b.game_id AND e.line = b.line),
ev5 AS (
  SELECT *,
         '(' || time || ') ' || coalesce(label, 'EQUIPO') || ': ' ||
         CASE WHEN action = 'shoot' THEN 'TIRO DE ' || CAST(value AS VARCHAR) || ' ' ||
                   CASE WHEN made_b THEN 'ANOTADO' ELSE 'FALLADO' END
              WHEN action = 'fthrow' THEN 'TIRO LIBRE ' || CASE WHEN made_b THEN 'ANOTADO' ELSE 'FALLADO' END
              WHEN action = 'assist' THEN 'ASISTENCIA'
              WHEN action = 'foul' THEN CASE WHEN event_id % 10 = 0 THEN 'FALTA Descalificante'
                                             WHEN event_id % 10 = 1 THEN 'FALTA Técnica'
                                             ELSE 'FALTA Personal' END
              WHEN action = 'subst' THEN CASE WHEN event_id % 2 = 0 THEN 'Entra a pista' ELSE 'Sale de pista' END
              WHEN action = 'lose' THEN 'PÉRDIDA' WHEN action = 'recovery' THEN 'RECUPERACIÓN'
              ELSE 'TAPÓN' END AS text,
         CASE WHEN action = 'shoot' AND made_b THEN value
              WHEN action = 'fthrow' AND made_b THEN 1 ELSE 0 END AS pts
  FROM ev4),
raw_plays AS (
  SELECT game_id, CAST(num AS INTEGER) AS num, quarter, time, text, team, action, player_id, team_id, event_id,
         CAST(CASE WHEN pts > 0 THEN sum(CASE WHEN team = 1 THEN pts ELSE 0 END) OVER w ELSE 0 END AS INTEGER) AS scoreA,
         CAST(CASE WHEN pts > 0 THEN sum(CASE WHEN team <> 1 THEN pts ELSE 0 END) OVER w ELSE 0 END AS INTEGER) AS scoreB
  FROM ev5
  WINDOW w AS (PARTITION BY game_id ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cls AS (
  SELECT *,
         CAST(CASE WHEN action NOT IN ('shoot', 'fthrow') THEN NULL
                   WHEN contains(text, 'ANOTADO') THEN 1 WHEN contains(text, 'FALLADO') THEN 0 END AS INTEGER) AS made,
         CASE WHEN action IN ('shoot', 'fthrow')
              THEN TRY_CAST(NULLIF(regexp_extract(text, 'TIRO DE (\d)', 1), '') AS INTEGER) END AS shot_value,
         CASE WHEN action IS NULL OR action <> 'foul' THEN NULL
              WHEN contains(text, 'Descalificante') THEN 'disqualifying'
              WHEN contains(text, 'cnica') THEN 'technical' ELSE 'personal' END AS foul_type,
         CASE WHEN action IS NULL OR action <> 'subst' THEN NULL
              WHEN contains(text, 'Entra') THEN 'in' ELSE 'out' END AS sub_direction
  FROM raw_plays WHERE text IS NOT NULL),
linked AS (
  SELECT *,
         CASE WHEN action = 'shoot' AND made = 1
                   AND lead(action) OVER g = 'assist'
                   AND lead(team) OVER g = team
                   AND lead(time) OVER g = time
              THEN lead(player_id) OVER g END AS assisted_by_player_id
  FROM cls WINDOW g AS (PARTITION BY game_id ORDER BY num)),
from_plays AS (
  SELECT game_id, player_id, is_home, initial, surnames FROM (
    SELECT game_id, player_id, num, team = 1 AS is_home,
           upper(substr(regexp_extract(text, '\)\s*([^:]+):', 1), 1, 1)) AS initial,
           upper(trim(regexp_replace(regexp_extract(text, '\)\s*([^:]+):', 1), '^\S+\.\s*', ''))) AS surnames,
           row_number() OVER (PARTITION BY game_id, player_id ORDER BY num) AS rn
    FROM cls WHERE player_id IS NOT NULL AND regexp_extract(text, '\)\s*([^:]+):', 1) <> '')
  WHERE rn = 1),
sheet AS (
  SELECT DISTINCT game_id, is_home, player_name,
         upper(trim(split_part(player_name, ',', 1))) AS surnames,
         upper(substr(trim(split_part(player_name, ',', 2)), 1, 1)) AS initial
  FROM players),
resolved AS (
  SELECT f.game_id, f.player_id, min(s.player_name) AS player_name
  FROM from_plays f JOIN sheet s
    ON f.game_id = s.game_id AND f.is_home = s.is_home AND f.initial = s.initial AND f.surnames = s.surnames
  GROUP BY f.game_id, f.player_id HAVING count(DISTINCT s.player_name) = 1),
plays AS (
  SELECT l.*, r.player_name, r2.player_name AS assisted_by_name
  FROM linked l
  LEFT JOIN resolved r ON l.game_id = r.game_id AND l.player_id = r.player_id
  LEFT JOIN resolved r2 ON l.game_id = r2.game_id AND l.assisted_by_player_id = r2.player_id)"""

SHOTS = """
shots0 AS (
  SELECT game_id, quarter, time, CAST(player_id % 12 + 4 AS INTEGER) AS player,
         CASE WHEN team = 1 THEN 0 ELSE 1 END AS team,
         CAST(CASE WHEN contains(text, 'ANOTADO') THEN 1 WHEN contains(text, 'FALLADO') THEN 0 END AS INTEGER) AS made,
         CAST((event_id * 37) % 101 AS DOUBLE) AS x, CAST((event_id * 53) % 101 AS DOUBLE) AS y,
         event_id
  FROM raw_plays WHERE action = 'shoot'),
shots1 AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY game_id, quarter, time, player, x, y
                                 ORDER BY team, made) AS rn_s
    FROM shots0) WHERE rn_s = 1),
shots AS (
  SELECT *, sqrt(dx * dx + dy * dy) AS shot_distance_m FROM (
    SELECT *, (x - CASE WHEN x < 50 THEN 5.0 ELSE 95.0 END) * CAST(0.28 AS DOUBLE) AS dx, (y - 50) * CAST(0.15 AS DOUBLE) AS dy
    FROM shots1)),
fshots AS (
  SELECT *, shot_distance_m > 6.6 AS is_three,
         CASE WHEN shot_distance_m <= 1.25 THEN 'rim' WHEN shot_distance_m <= 6.6 THEN 'mid' ELSE 'three' END AS zone,
         CASE WHEN made = 1 THEN CASE WHEN shot_distance_m > 6.6 THEN 3 ELSE 2 END ELSE 0 END AS shot_points
  FROM shots)"""


def with_layers(*layers: str) -> str:
    """WITH clause holding the named layers and what they depend on."""
    order = ["headers", "lines", "games", "teams", "plays", "shots"]
    need = set(layers)
    if need & {"games", "teams", "plays", "shots"}:
        need |= {"headers", "lines"}
    if "shots" in need:
        need |= {"plays"}
    if "lines" in need:
        need.add("headers")
    text = {"headers": HEADERS, "lines": LINES, "games": GAMES, "teams": TEAMS,
            "plays": PLAYS, "shots": SHOTS}
    return "WITH " + ",".join(text[k] for k in order if k in need) + "\n"

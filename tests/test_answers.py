"""Worked answers with known values (our own small inputs)."""
import datetime as dt

from pyspark.sql import functions as F

from courtside.plans import compare as C
from courtside.plans import playbyplay as P
from courtside.plans import sheets as S


def test_percentiles(spark):
    pool = spark.createDataFrame([("L", 2025, "a", 10.0), ("L", 2025, "b", 20.0), ("L", 2025, "c", 30.0)],
                                 "competition string, season int, player_name string, avg_pts double")
    rows = spark.createDataFrame([("L", 2025, "b", 20.0), ("L", 2025, "c", 30.0), ("L", 2025, "x", None),
                                  ("L", 2025, "y", 25.0), ("M", 2025, "z", 5.0)],
                                 "competition string, season int, player_name string, avg_pts double")
    got = {r.player_name: r.percentile for r in C.percentiles(pool, rows, axes=[("pts", "avg_pts")]).collect()}
    assert got == {"b": 67, "c": 100, "x": None, "y": 67, "z": None}


def test_fouls_roll_up(spark):
    g = [(i, "L", 2025, "A", dt.date(2025, 10, 1) + dt.timedelta(days=i), "H", "V", 70, 60) for i in range(20)]
    games = spark.createDataFrame(g, "game_id long, competition string, season int, grp string, game_date date, "
                                     "home_team string, away_team string, home_score int, away_score int")
    players = spark.createDataFrame(
        [(i, "L", 2025, "A", dt.date(2025, 10, 1) + dt.timedelta(days=i), "H", "P, Q") for i in range(20)],
        "game_id long, competition string, season int, grp string, game_date date, team string, player_name string")
    rows = ([(0, n, "foul", "personal") for n in range(3)] + [(1, 10 + n, "foul", "personal") for n in range(5)]
            + [(1, 20, "foul", "technical")])
    plays = spark.createDataFrame([(g, n, 1, a, ft, "P, Q") for g, n, a, ft in rows],
                                  "game_id long, num int, team int, action string, foul_type string, player_name string")
    r = P.player_fouls(plays, games, players).first()
    assert (r.personal_fouls, r.technical_fouls, r.total_fouls, r.games) == (8, 1, 9, 20)
    assert abs(r.fouls_per_game - 0.45) < 1e-12 and r.fouled_out_games == 1 and r.games_with_foul == 2
    t = P.team_fouls(plays, games, players).first()
    assert (t.team, t.total_fouls, t.games) == ("H", 9, 20)


def test_assist_nodes(spark):
    edges = spark.createDataFrame([("L", 2025, "A", "B", "T", 12, 26, 1)],
                                  "competition string, season int, passer string, scorer string, team string, "
                                  "assists long, points long, edge_rank int")
    n = {r.name: (r.assists_given, r.assists_received, r.points_created) for r in P.assist_nodes(edges).collect()}
    assert n == {"A": (12, 0, 0), "B": (0, 12, 26)}


def test_pace_worked_example(spark):
    teams = spark.createDataFrame([(1, "H", 78, 30, 20, 10, 12, 15), (1, "V", 70, 26, 20, 8, 14, 10)],
                                  "game_id long, team_name string, points int, t2a int, t3a int, off_reb int, "
                                  "tov int, fta int")
    games = spark.createDataFrame([(1, "L", 2025, "A", "01/10/2025")],
                                  "game_id long, competition string, season int, grp string, date string")
    r = {x.team: x for x in S.pace(teams, games).collect()}
    ph, pv = 50 - 10 + 12 + 0.44 * 15, 46 - 8 + 14 + 0.44 * 10
    assert abs(r["H"].ortg - 78 / ph * 100) < 1e-9 and abs(r["H"].drtg - 70 / pv * 100) < 1e-9
    assert abs(r["H"].possessions - (ph + pv) / 2) < 1e-9 and r["H"].won and not r["V"].won


def test_game_log_and_zones(spark):
    players = spark.createDataFrame([(1, "L", 2025, "P, Q", False, 5.0, 10, 3, 2, 9, 7, "V")],
                                    "game_id long, competition string, season int, player_name string, is_home boolean, "
                                    "minutes double, points int, reb int, ast int, val int, jersey int, team string")
    games = spark.createDataFrame([(1, "01/10/2025", dt.date(2025, 10, 1), "H", "V", 77, 78)],
                                  "game_id long, date string, game_date date, home_team string, away_team string, "
                                  "home_score int, away_score int")
    r = S.game_log(players, games).first()
    assert (r.opponent, r.score, r.won, r.is_best_points) == ("H", "77-78", True, True)
    shots = spark.createDataFrame([(1, 7, 1, 1, "rim", 1.0, 5.0, 50.0), (1, 7, 1, 0, "mid", 4.0, 20.0, 50.0),
                                   (1, 7, 1, 1, "three", 7.0, 30.0, 50.0), (1, 7, 0, 1, "rim", 1.0, 5.0, 50.0)],
                                  "game_id long, player int, team int, made int, zone string, "
                                  "shot_distance_m double, x double, y double")
    z = {x.zone: (x.made, x.att, x.pct) for x in S.zones(players, shots).collect()}
    assert z == {"rim": (1, 1, 1.0), "mid": (0, 1, 0.0), "three": (1, 1, 1.0)}

"""Declared schemas. The raw game document is never inferred: an all-empty
``team_stats`` or ``shots`` in scope would otherwise change the types."""
from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

META = T.StructType([T.StructField(n, t) for n, t in [
    ("game_id", L), ("date", S), ("time", S), ("venue", S), ("home_team", S), ("away_team", S),
    ("home_score", I), ("away_score", I), ("scraped_at", S), ("source", S), ("group", S)]])

PLAYER = T.StructType([T.StructField(n, t) for n, t in [
    ("jersey", I), ("name", S), ("player_id", S), ("minutes", D), ("points", I),
    ("two_points_made", I), ("two_points_attempted", I), ("three_points_made", I),
    ("three_points_attempted", I), ("free_throws_made", I), ("free_throws_attempted", I),
    ("offensive_rebounds", I), ("defensive_rebounds", I), ("total_rebounds", I), ("assists", I),
    ("steals", I), ("blocks", I), ("turnovers", I), ("fouls", I), ("plus_minus", I), ("efficiency", I)]])

# Play lines are read as text and typed in silver (values vary by source).
LINE = T.StructType([T.StructField(n, S) for n in
                     ["num", "quarter", "time", "text", "team", "action", "scoreA", "scoreB",
                      "idPlayer", "idTeam"]])

SHOT = T.StructType([T.StructField(n, S) for n in ["quarter", "t", "player", "team", "m", "x", "y"]])

TEAM = T.StructType([T.StructField(n, S) for n in
                     ["id", "name", "pts", "p2m", "p2a", "p3m", "p3a", "p1m", "p1a", "ro", "rd", "rt",
                      "assist", "st", "to", "bs", "pf"]])

GAME = T.StructType([
    T.StructField("meta", META),
    T.StructField("players_home", T.ArrayType(PLAYER)),
    T.StructField("players_away", T.ArrayType(PLAYER)),
    T.StructField("play_by_play", T.ArrayType(LINE)),
    T.StructField("shots", T.ArrayType(SHOT)),
    T.StructField("team_stats", T.StructType([T.StructField("TEAM", T.ArrayType(TEAM))])),
])

# Partition columns of the raw path, as discovered from the folder names.
RAW_PARTITIONS = T.StructType([T.StructField("competition", S), T.StructField("year", I),
                               T.StructField("group", S)])
GAME_WITH_PATH = T.StructType(GAME.fields + RAW_PARTITIONS.fields)

# FIXED VALUES: columns and types of the five serving tables, the columns whose
# NULL becomes 0, and the keys their files are sorted by. Column of ours ->
# type; a smaller whole number type where the source declares one.
_BOX = {c: "smallint" for c in ("t2m", "t2a", "t3m", "t3a", "ftm", "fta", "ast", "stl", "blk", "tov", "pf")}
SERVING = {
    "games": ({"game_id": "bigint", "competition": "string", "grp": "string", "season": "int", "date": "string",
               "game_date": "date", "home_team": "string", "away_team": "string", "home_score": "int",
               "away_score": "int", "total_points": "int", "winner": "string"}, (), ("game_id",)),
    "players": ({"game_id": "bigint", "competition": "string", "grp": "string", "season": "int", "game_date": "date",
                 "jersey": "smallint", "player_name": "string", "team": "string", "is_home": "boolean",
                 "minutes": "float", "points": "int", **_BOX, "reb": "smallint", "plus_minus": "smallint",
                 "val": "smallint"}, (), ("player_name", "game_date")),
    "plays": ({"game_id": "bigint", "competition": "string", "season": "int", "quarter": "smallint", "time": "string",
               "text": "string", "team": "smallint", "action": "string", "scoreA": "int", "scoreB": "int",
               "player_id": "bigint", "team_id": "bigint", "made": "smallint", "shot_value": "smallint",
               "foul_type": "string", "sub_direction": "string", "assisted_by_player_id": "bigint",
               "player_name": "string", "assisted_by_name": "string"}, ("team", "scoreA", "scoreB"),
              ("game_id", "quarter")),
    "shots": ({"game_id": "bigint", "competition": "string", "season": "int", "quarter": "smallint", "time": "string",
               "player": "smallint", "team": "smallint", "made": "smallint", "x": "double", "y": "double",
               "shot_distance_m": "float", "zone": "string", "is_three": "boolean", "shot_points": "smallint"}, (),
              ("game_id", "quarter")),
    "teams": ({"game_id": "bigint", "competition": "string", "season": "int", "team_id": "bigint",
               "team_name": "string", "points": "int", **_BOX, "off_reb": "smallint", "def_reb": "smallint",
               "tot_reb": "smallint"}, (), ("game_id", "team_id")),
}

"""The five serving tables as one bundle, from any source."""
from __future__ import annotations

import functools
import hashlib
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, model
from ..sources import driver
from ..sources.lake import large_games


@dataclass
class Tables:
    games: DataFrame      # one row per played game, score rebuilt (B13)
    players: DataFrame    # silver box score, one row per player and game (B06)
    plays: DataFrame      # silver play-by-play, names resolved (B08)
    shots: DataFrame      # gold shots with distance and zone (B15)
    teams: DataFrame      # silver team box score (B10)
    dealt: int | None = None  # tasks that players and teams lie dealt to by game, where they do


DEAL_ROWS = 400_000  # box-score lines a task makes
LARGE_ORDER = 100_000  # lines of an order that are too many for one task
FEW_GAMES = 1_000_000  # games with plays whose ids every executor may hold
DEAL_PLAYS = 100_000  # plays a task numbers, scores and links
LARGE_GAME = 100_000  # plays of a game that are too many for one task

TIMINGS: dict[str, float] = {}


def build_layers(spark: SparkSession, sf_dir: str, root: str, exists, parallel: bool = True) -> Tables:
    """Bronze -> silver -> gold as written tables, each stage reading the
    previous stage's output (no sub-plan is computed twice).

    Stages that do not depend on each other are submitted together from
    threads, so their jobs share the executors (a small stage never leaves
    the cluster idle while a neighbour waits):
    {bronze plays, players} -> {games, teams, linked plays, shots} -> plays.
    """
    from concurrent.futures import ThreadPoolExecutor

    def stage(name: str, make, buckets: int | None = None) -> DataFrame:
        path = f"{root}/{name}"
        made = exists(f"{path}/_SUCCESS")
        if not made:
            t0 = time.time()
            w = make().write.mode("overwrite").option("compression", "zstd")
            if buckets:
                w.option("path", path).bucketBy(buckets, "game_id").sortBy("game_id").format("parquet").saveAsTable(new_table(name))
            else:
                w.parquet(path)
            TIMINGS[name] = round(time.time() - t0, 3)
        d = spark.read.parquet(path)
        if not buckets:
            return d
        # An external table: files under ``root``, named in this session's catalog if they are not yet.
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table_name(name)} ({columns}) USING parquet "
                  f"CLUSTERED BY (game_id) SORTED BY (game_id) INTO {buckets} BUCKETS LOCATION '{path}'")
        return spark.table(table_name(name))

    def table_name(name: str) -> str:
        return f"courtside_{hashlib.sha1(root.encode()).hexdigest()[:12]}_{name}"

    def new_table(name: str) -> str:
        spark.sql(f"DROP TABLE IF EXISTS {table_name(name)}")
        return table_name(name)

    def together(**makers) -> dict:
        if not parallel:
            return {k: stage(k, m, buckets(k)) for k, m in makers.items()}
        with ThreadPoolExecutor(max_workers=len(makers)) as pool:
            futures = {k: pool.submit(stage, k, m, buckets(k)) for k, m in makers.items()}
            return {k: f.result() for k, f in futures.items()}

    @functools.cache
    def tasks() -> int | None:
        """Tasks that lines are dealt to by order; None where an order is too large for that."""
        rows, large = large_games([driver.read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "game_id")], LARGE_ORDER)
        return rows // DEAL_ROWS + 1 if large is None else None

    def buckets(name: str) -> int | None:
        """Players are dealt by game when they are made, and so their team rows and the plays; bucketed so,
        what is grouped by game next is not dealt again."""
        return tasks() if name in ("players", "teams") else plays_tasks if name in ("bronze_plays", "plays_linked") else None

    # The plays need the lines of their own games only. Where these are few, the lines and names of
    # all others are left out before anything is dealt; where not, the lines are written first.
    per_game = stage("played", lambda: driver.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("game_id"))
                     .agg(F.count(F.lit(1)).alias("n")))
    played = per_game.select("game_id").where("game_id IS NOT NULL")
    found = per_game.agg(F.count("game_id").alias("games"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    few = found.games <= FEW_GAMES
    # Tasks that plays are dealt to by game, once; None where a game (or an order) is too large for that.
    # Plays without a game are one too.
    plays_tasks = (found.rows or 0) // DEAL_PLAYS + 1 if few and tasks() and (found.most or 0) <= LARGE_GAME else None

    def of_played(df: DataFrame, key: str = "game_id") -> DataFrame:
        return df.join(F.broadcast(played.withColumnRenamed("game_id", key)), key, "left_semi") if few else df

    def make_players() -> DataFrame:
        # Made of the driver tables where that leaves a game's lines together: dealing these
        # narrow rows costs less than dealing written wide ones, and nothing is sorted before it.
        dealt = driver.lines(spark, sf_dir, tasks()) if tasks() or few else lines
        return clean.clean_players(dealt.drop("_surnames", "_given", "player_id"))

    lines = driver.lines(spark, sf_dir, plays_tasks, of=of_played) if few else stage("bronze_lines", lambda: driver.lines(spark, sf_dir, tasks()))
    lvl2 = together(
        bronze_plays=lambda: driver.plays(spark, sf_dir, lines=lines, tasks=plays_tasks),
        players=make_players)
    raw_plays, players = lvl2["bronze_plays"], lvl2["players"]
    lvl3 = together(
        games=lambda: model.fact_games(players),
        # team rows are grouped by (game, side, team): one per (game, team id)
        teams=lambda: clean.clean_teams(clean.team_box(players), unique=True),
        plays_linked=lambda: clean.link_assists(clean.classify_plays(raw_plays), whole=bool(plays_tasks)),
        shots=lambda: model.fact_shots(clean.clean_shots(driver.shots(spark, sf_dir, raw_plays))))
    plays = stage("plays", lambda: clean.resolve_names(lvl3["plays_linked"], of_played(players), dealt=plays_tasks))
    return Tables(games=lvl3["games"], players=players, plays=plays, shots=lvl3["shots"], teams=lvl3["teams"],
                  dealt=tasks())

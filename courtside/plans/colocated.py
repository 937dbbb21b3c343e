"""Layer tables bucketed by game, for joins without a shuffle.

Plays, players and games are written as bucketed tables: the same number of
buckets, each hashed and sorted by (game, piece). A join on these two columns
reads bucket by bucket, so neither side is exchanged, however often it is asked.

A game with more than ``piece_rows`` rows in a table is cut into pieces by a
hash of the whole row (rows of a layer table are distinct), and its row of
``games`` is written once per piece: at most one copy per ``piece_rows`` rows.
Every row still meets its game exactly once, and a bucket holds no more
of a hot game than a few pieces. Rows without a game are piece 0 and join nothing.

The tables are external: files under ``root``, named in the session's catalog.
``open_colocated`` names them again in a later session, from the description
written beside them after the last table.
"""
from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staged import Files
from .context import PIECE

KEYS = ("game_id", PIECE)
DESCRIPTION = "_colocated.json"
TABLES = ("plays", "players", "games")


@dataclass
class Colocated:
    """``games`` has a row per game and piece: for joins with ``plays`` or ``players`` only."""
    plays: DataFrame
    players: DataFrame
    games: DataFrame
    buckets: int


def pieces(tables: dict[str, DataFrame], piece_rows: int) -> DataFrame:
    """``game_id, parts`` of every game in any of the tables, ``rows`` of all of them."""
    counts = [d.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")) for d in tables.values()]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.where("game_id IS NOT NULL").groupBy("game_id").agg(
        F.ceil(F.max("n") / piece_rows).cast("int").alias("parts"), F.sum("n").alias("rows"))


def _piece_of_rows(df: DataFrame, hot: DataFrame) -> DataFrame:
    """``hot`` lists only games of several pieces: few rows, which is for the planner to find out."""
    d = df.join(hot, "game_id", "left")
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce("parts", F.lit(1)))
    return d.select(*df.columns, piece.cast("int").alias(PIECE))


def _table_name(root: str, name: str) -> str:
    return f"courtside_{hashlib.sha1(root.encode()).hexdigest()[:12]}_{name}"


def write_colocated(plays: DataFrame, players: DataFrame, games: DataFrame, root: str,
                    piece_rows: int = 1_000_000, bucket_rows: int = 4_000_000) -> Colocated:
    """Write the tables under a new folder ``root``. The number of buckets follows from the rows of
    plays and players (``bucket_rows`` a bucket of both)."""
    spark = plays.sparkSession
    parts = f"{root}/_parts"
    pieces({"plays": plays, "players": players}, piece_rows).write.mode("overwrite").parquet(parts)
    parts = spark.read.parquet(parts)
    buckets = max(1, -(-int(parts.agg(F.sum("rows")).first()[0] or 0) // bucket_rows))
    hot = parts.where("parts > 1").select("game_id", "parts")
    copies = games.join(hot, "game_id", "left").select(
        *games.columns, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias(PIECE))
    schemas = {}
    for name, df in (("plays", _piece_of_rows(plays, hot)), ("players", _piece_of_rows(players, hot)), ("games", copies)):
        table = _table_name(root, name)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        # Dealt as the buckets are: every task writes one file.
        (df.repartition(buckets, *KEYS).write.format("parquet").mode("overwrite").option("path", f"{root}/{name}")
         .bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(table))
        schemas[name] = df.schema.jsonValue()
    Files(spark, root).write(f"{root}/{DESCRIPTION}", json.dumps({"buckets": buckets, "schemas": schemas}))
    return open_colocated(spark, root)


def open_colocated(spark: SparkSession, root: str) -> Colocated:
    """The tables of ``root``, named in this session's catalog if they are not yet."""
    from pyspark.sql.types import StructType
    about = json.loads(Files(spark, root).read(f"{root}/{DESCRIPTION}"))
    keys = ", ".join(KEYS)
    for name in TABLES:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(about["schemas"][name]))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_table_name(root, name)} ({columns}) USING parquet "
                  f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {about['buckets']} BUCKETS LOCATION '{root}/{name}'")
    return Colocated(**{n: spark.table(_table_name(root, n)) for n in TABLES}, buckets=about["buckets"])

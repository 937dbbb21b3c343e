"""Incremental raw loads with Structured Streaming.

The reference refreshes a season by re-running a batch job from cron and
skipping stored games. Here new game documents are picked up by a file
stream with the declared schema. Every micro-batch is parsed once into a
staged table, turned into bronze rows from there and written under folders
named by its batch id, so a replayed batch overwrites its own output and
nothing else (exactly once with the stream's checkpoint). A game that is
delivered again (a corrected document, in a new file) replaces its earlier
rows when the tables are read: its latest batch wins.
``trigger(availableNow=True)`` processes what has arrived and stops, which is
the cron-style use; a processing-time trigger keeps it running.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lake
from ..sources.schema import GAME_WITH_PATH

BRONZE = {"games": lake.bronze_games, "players": lake.bronze_players, "plays": lake.bronze_plays,
          "shots": lake.bronze_shots, "teams": lake.bronze_teams}

FEW_GAMES = 100_000  # games delivered again that every executor may hold


def raw_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """New documents under the raw layout, partition columns from the path."""
    return (spark.readStream.schema(GAME_WITH_PATH).option("basePath", root)
            .option("maxFilesPerTrigger", max_files)
            .json(f"{root}/competition=*/year=*/group=*"))


def load_bronze(spark: SparkSession, raw_root: str, out_root: str, checkpoint: str,
                once: bool = True, max_files: int = 1000):
    """Start the incremental bronze load; returns the streaming query. The
    caller owns ``out_root`` and ``checkpoint``."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        staged = f"{out_root}/documents/batch={batch_id}"
        batch.withColumn("year", F.col("year").cast("int")).write.mode("overwrite").parquet(staged)
        docs = batch.sparkSession.read.parquet(staged)
        for name, build in BRONZE.items():
            build(docs).write.mode("overwrite").parquet(f"{out_root}/{name}/batch={batch_id}")

    writer = (raw_stream(spark, raw_root, max_files).writeStream
              .foreachBatch(write_batch).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_bronze(spark: SparkSession, out_root: str, name: str) -> DataFrame:
    """One bronze table over all batches (the batch id is a column), each
    game from its latest delivery. Rows meet only the games that were delivered again."""
    def batches(table: str) -> DataFrame:
        return spark.read.option("basePath", f"{out_root}/{table}").parquet(f"{out_root}/{table}/batch=*")

    df = batches(name).where("game_id IS NOT NULL")
    times = batches("games").where("game_id IS NOT NULL").groupBy("game_id").agg(
        F.max("batch").alias("_latest"), F.min("batch").alias("_first"))
    again = times.where("_latest > _first").select(F.col("game_id").alias("_again"), "_latest")
    found = again.count()
    if not found:
        return df
    # By their number: their size is estimated from compressed files, so millions of games may look small.
    again = F.broadcast(again) if found <= FEW_GAMES else again.hint("merge")
    d = df.join(again, F.col("game_id") == F.col("_again"), "left")
    return d.where("_again IS NULL OR batch = _latest").select(*df.columns)

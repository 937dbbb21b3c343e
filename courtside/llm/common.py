"""Shared helpers: intermediate tables, column checks, Arrow batch bounds."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Rows per Arrow batch handed to Python: keeps a batch of very long texts
# within an executor's memory (1,000 texts of 100 kB are 100 MB).
BATCH_ROWS = 1000


# Folder that holds the package, for Python workers on this machine; on a
# cluster the package travels with the job (--py-files).
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the jobs started from this session, and let
    local Python workers import this package whatever the working folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/courtside-llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast by its estimated size: Spark takes the bytes of compressed
    files for it and does not count the rows an explode adds, so millions of rows may look small."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % m

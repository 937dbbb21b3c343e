"""De-duplicate by key with a total order on the survivors.

``dropDuplicates`` keeps any row; here the first row by ``order`` wins,
so the answer is the same on every run and every partitioning. It is an
aggregate, not a window: map-side partial aggregation collapses a hot group
of copies before the shuffle, so a key that holds a third of all rows never
lands whole in one task.
"""
from __future__ import annotations

from collections.abc import Sequence
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

FEW_KEYS = 100_000  # keys of several rows that every executor may hold


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    keys = list(keys)
    order = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)])
    out = df.groupBy(*keys).agg(F.min(packed).alias("__w"))
    cols = ([F.col(k) for k in keys]
            + [F.col(f"__w.o{i}").alias(c) for i, c in enumerate(order)]
            + [F.col(f"__w.r{i}").alias(c) for i, c in enumerate(rest)])
    return out.select(*cols).select(*df.columns)


def first_of_few(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The same where few rows share a key: their keys are found first, by a shuffle of hashes alone,
    and only rows of such a hash are dealt and compared. With many of them it is :func:`first_by`."""
    spark = df.sparkSession
    hashed = df.withColumn("__k", F.xxhash64(*keys))
    path = f"{checkpoint_dir(spark)}/courtside-repeated/{uuid.uuid4().hex[:12]}"
    hashed.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__k").write.parquet(path)
    again = spark.read.schema("__k long").parquet(path)
    found = again.count()
    if not found:
        return df
    if found > FEW_KEYS:
        return first_by(df, keys, order)
    again = F.broadcast(again)
    single = hashed.join(again, "__k", "left_anti").select(*df.columns)
    return single.unionByName(first_by(hashed.join(again, "__k", "left_semi").select(*df.columns), keys, order))

"""Query set against all vectors, in blocks: shards of an index meet blocks of queries.

An index is a table with one row per shard (its arrays as bytes); queries are
dealt into blocks. A (shard, block) pair is one task's group, bounded by
``shard_rows`` and ``block_rows`` whatever the input; its result is ``k`` rows
per query, and the final top k is a window over those, limited map side.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

INDEX = "dim int, shard int, tree binary"


def valid_vectors(df: DataFrame, nonzero: bool) -> DataFrame:
    """``(vec_id, v array<double>, dim)`` of rows that take part: id and vector
    not null, no null or non-finite component, with ``nonzero`` not all zero.
    Rows that share a vec_id count once, with their smallest vector."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    if nonzero:
        ok &= F.exists(v, lambda x: x != 0)
    kept = df.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return kept.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame, build: Callable[[np.ndarray, np.ndarray], bytes], shard_rows: int) -> tuple[DataFrame, int]:
    """One row per (dim, shard): ``build(ids, matrix)`` as bytes. Returns the
    written index and the number of shards."""
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]],
                             "tree": [build(pdf["vec_id"].to_numpy(), matrix(pdf["v"], key[0]))]})

    return written(dealt.groupBy("dim", "shard").applyInPandas(make, INDEX), "index"), shards


def matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64).reshape(len(col), dim)


def search(index: DataFrame, shards: int, queries: DataFrame, k: int, order: list[Column], score: str,
           find: Callable[[bytes, np.ndarray, np.ndarray], list[tuple]], block_rows: int) -> DataFrame:
    """``find(tree, ids, matrix)`` gives (query_id, vec_id, score) rows of a
    block of queries in a shard; the best ``k`` per query remain, ranked by ``order``."""
    blocks = max(1, math.ceil(queries.count() / block_rows))
    q = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        "dim", "shard", "block", "vec_id", "v")
    t = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            rows = find(left["tree"].iloc[0], right["vec_id"].to_numpy(), matrix(right["v"], key[0]))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = t.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(
        meet, f"query_id long, vec_id long, score {score}")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

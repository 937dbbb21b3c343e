"""Exact top-k inner product by pivot-table elimination.

Each shard picks pivots far from one another and keeps every vector's distance
to each (the pivot table). For a query the largest difference of pivot
distances bounds its distance to a vector from below, hence, with both norms,
the inner product from above. Candidates are evaluated in bound order until
the k-th score found exceeds every bound left: the result is exact. The whole
query set meets all vectors in blocks (see :mod:`.blocks`).

Vectors are scaled to integers first (floor(256 x)), so scores are whole
numbers; they are summed exactly, beyond 2**53 with unbounded integers (a
score outside a long is cut to its bounds).

Defined cases: vectors null, or with null or non-finite components, and rows
with a null id take no part; rows that share a vec_id count once with their
smallest vector; only vectors of equal length meet; ties go to the smaller
vec_id; fewer than k candidates give fewer rows; empty tables give an empty
table; extra columns are ignored.
"""
from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import build_index, search, valid_vectors
from .common import bound_batches

EXACT = 2.0 ** 53
LONG = 2 ** 63


def pivot_table(ids: np.ndarray, x: np.ndarray, pivots: int) -> bytes:
    """Index of a shard: ids, vectors, squared norms, pivots, distances to them."""
    chosen = [0]
    near = np.full(len(x), np.inf)
    table = []
    while True:
        d = np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1))
        table.append(d)
        near = np.minimum(near, d)
        if len(chosen) == min(pivots, len(x)) or near.max() == 0:
            break
        chosen.append(int(near.argmax()))  # the vector farthest from all pivots so far
    out = io.BytesIO()
    np.savez(out, ids=ids, x=x, norms=(x ** 2).sum(axis=1), pivots=x[chosen], table=np.array(table))
    return out.getvalue()


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    big = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if big < EXACT:
        return (x @ q).astype(np.int64)
    qi = [int(c) for c in q]
    sums = (sum(int(a) * b for a, b in zip(row, qi)) for row in x)
    return np.array([max(-LONG, min(LONG - 1, s)) for s in sums], dtype=np.int64)


def top_in_shard(tree: bytes, query_ids: np.ndarray, queries: np.ndarray, k: int, chunk: int = 256) -> list[tuple]:
    """(query_id, vec_id, score) of the best k of the shard for each query."""
    t = np.load(io.BytesIO(tree))
    ids, x, norms, pivots, table = (t[n] for n in ("ids", "x", "norms", "pivots", "table"))
    rows = []
    for qid, q in zip(query_ids, queries):
        to_pivots = np.sqrt(((pivots - q) ** 2).sum(axis=1))
        apart = np.zeros(len(x))
        for d, row in zip(to_pivots, table):  # maximum of the lower bounds of the distance
            np.maximum(apart, np.abs(row - d), out=apart)
        size = norms + (q ** 2).sum()
        bound = (size - apart ** 2) / 2 + 1e-9 * (size + 1)  # upper bound of the score, rounding included
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[int, int]] = []  # (-score, vec_id)
        at, step = 0, chunk
        while at < len(order):
            if len(best) == k and -best[-1][0] > bound[order[at]]:
                break  # exact stop: every bound left is below the k-th score
            part = order[at:at + step]
            part = part[ids[part] != qid]
            s = _scores(x[part], q)
            if len(best) == k:
                keep = s >= -best[-1][0]
                part, s = part[keep], s[keep]
            best = sorted(best + [(-a, i) for a, i in zip(s.tolist(), ids[part].tolist())])[:k]
            at, step = at + step, step * 2
        rows.extend((int(qid), v, -s) for s, v in best)
    return rows


def top_products(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = 32,
                 shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """Best ``k`` rows of ``vectors`` by integer inner product for every row of
    ``queries`` (both ``(vec_id, v, dim)``, see :func:`integer_vectors`)."""
    index, shards = build_index(vectors, lambda ids, x: pivot_table(ids, x, pivots), shard_rows)
    return search(index, shards, queries, k, [F.col("score").desc(), F.col("vec_id")], "long",
                  lambda tree, ids, x: top_in_shard(tree, ids, x, k), block_rows)


def integer_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """``(vec_id, v, dim)`` with v = floor(scale * x), x as double."""
    bound_batches(embeddings.sparkSession)
    v = valid_vectors(embeddings, nonzero=False)
    return v.withColumn("v", F.transform("v", lambda x: _floor(x * scale)))


def _floor(x):
    """floor() kept as a double, exact at any size."""
    inside = F.abs(x) < F.lit(2.0 ** 52)
    return F.when(inside, F.floor(F.when(inside, x).otherwise(F.lit(0.0))).cast("double")).otherwise(x)

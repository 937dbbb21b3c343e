"""Approximate nearest neighbours: a vantage-point tree per shard.

A node keeps a vantage point and, for either half of its points, the interval
of their distances to it. By the triangle inequality no point of a half can be
nearer to a query than the query's distance to the vantage point lies outside
that interval. A half is skipped when ``factor`` times this bound exceeds the
k-th distance found: factor one restores exact search, larger factors skip
more. Distances are Euclidean, in double precision, on the original vectors;
every row is indexed. The query set meets all shards in blocks (:mod:`.blocks`).

Defined cases: vectors null, zero, or with null or non-finite components,
and rows with a null id take no part; rows that share a vec_id count once with
their smallest vector; only vectors of equal length meet; equal vectors tie
and go by the smaller vec_id; fewer than k candidates give fewer rows; empty
tables give an empty table; extra columns are ignored.
"""
from __future__ import annotations

import io
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import build_index, search, valid_vectors
from .common import bound_batches


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def build_tree(ids: np.ndarray, x: np.ndarray, leaf: int, tries: int = 5) -> bytes:
    """Tree of a shard. Points are stored leaf by leaf, vantage points apart.

    ``child[n]`` holds a node's two halves: a node number, or ``-1 - l`` for
    leaf l; ``bounds[n]`` the two halves' distance intervals. Halves are cut
    at the median rank, so equal vectors never make a tree deep.
    """
    rnd = np.random.default_rng(len(ids))
    child, bounds, vantage, leaves = [], [], [], []

    def leaf_of(points: np.ndarray) -> int:
        leaves.append(points)
        return -len(leaves)

    root = [0]
    todo = [(np.arange(len(ids)), root, 0)]
    while todo:
        points, parent, side = todo.pop()
        if len(points) <= leaf:
            parent[side] = leaf_of(points)
            continue
        # Of a few points the one whose distances spread most is the vantage point.
        some = rnd.choice(points, min(tries, len(points)), replace=False)
        sample = x[rnd.choice(points, min(64, len(points)), replace=False)]
        v = max(some, key=lambda i: distances(sample, x[i]).var())
        rest = points[points != v]
        d = distances(x[rest], x[v])
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        parts = order[:half], order[half:]
        own = [0, 0]
        child.append(own)
        vantage.append(v)
        bounds.append([(d[p].min(), d[p].max()) for p in parts])
        parent[side] = len(child) - 1
        todo += [(rest[p], own, i) for i, p in enumerate(parts)]
    points = np.concatenate(leaves) if leaves else np.arange(0)
    out = io.BytesIO()
    np.savez(out, root=np.array(root), child=np.array(child, dtype=np.int64).reshape(-1, 2),
             bounds=np.array(bounds, dtype=np.float64).reshape(-1, 2, 2),
             cuts=np.cumsum([0] + [len(p) for p in leaves]), ids=ids[points], x=x[points],
             vantage_ids=ids[vantage] if vantage else ids[:0], vantage_x=x[vantage] if vantage else x[:0])
    return out.getvalue()


def nearest_in_shard(tree: bytes, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> list[tuple]:
    """(query_id, vec_id, distance) of the k nearest found in the shard."""
    t = np.load(io.BytesIO(tree))
    child, bounds, cuts = t["child"].tolist(), t["bounds"].tolist(), t["cuts"].tolist()
    ids, x, v_ids, v_x, root = t["ids"], t["x"], t["vantage_ids"], t["vantage_x"], int(t["root"][0])
    v_list = v_ids.tolist()
    rows = []
    for qid, q in zip(query_ids.tolist(), queries):
        to_v = distances(v_x, q).tolist()
        best: list[tuple[float, int]] = []
        far = np.inf
        heap = [(0.0, root)]
        while heap:
            low, n = heappop(heap)
            if low * factor > far:
                break  # halves come nearest bound first
            if n < 0:
                part = slice(cuts[-n - 1], cuts[-n])
                d = distances(x[part], q)
                near = np.nonzero(d <= far)[0]
                found = [(a, i) for a, i in zip(d[near].tolist(), ids[part][near].tolist()) if i != qid]
            else:
                d = to_v[n]
                found = [(d, v_list[n])] if d <= far and v_list[n] != qid else []
                for side in (0, 1):
                    lo, hi = bounds[n][side]
                    b = max(low, lo - d, d - hi)
                    if b * factor <= far:
                        heappush(heap, (b, child[n][side]))
            if found:
                best = sorted(best + found)[:k]
                if len(best) == k:
                    far = best[-1][0]
        rows.extend((qid, i, d) for d, i in best)
    return rows


def vectors(embeddings: DataFrame) -> DataFrame:
    bound_batches(embeddings.sparkSession)
    return valid_vectors(embeddings, nonzero=True)


def nearest(all_vectors: DataFrame, queries: DataFrame, k: int, factor: float = 1.0, leaf: int = 64,
            shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """``k`` nearest rows of ``all_vectors`` found for every row of ``queries``
    (both ``(vec_id, v, dim)``, see :func:`vectors`); ``score`` is the distance."""
    index, shards = build_index(all_vectors, lambda ids, x: build_tree(ids, x, leaf), shard_rows)
    return search(index, shards, queries, k, [F.col("score"), F.col("vec_id")], "double",
                  lambda tree, ids, x: nearest_in_shard(tree, ids, x, k, factor), block_rows)

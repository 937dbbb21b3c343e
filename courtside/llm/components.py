"""Connected components of an edge table by alternating star contraction.

Every round is two equi-joins/aggregations over the edges; rounds grow with
the logarithm of the longest path. Edges are cut to a written table after
every round, so a lost executor redoes one round at most. No link leaves the
executors; the driver only sees one boolean per round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Large star: every neighbour above a node moves to the node's smallest
    neighbour (itself included). Small star: a node and its neighbours below
    move to the smallest of them. The minimum per node is a map-side
    combined aggregate joined back (AQE splits a hot node's rows), never a
    per-node list.
    """
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    both = near.join(low, "u")
    if large:
        moved = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges(a, b)`` (any order, comparable type) -> ``(node, component)``,
    the component being its smallest node. Nodes without an edge to another
    node do not appear. Null ends and self links are ignored; no edges give
    an empty table.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    for _ in range(max_rounds):
        nxt = written(_star(_star(e, True), False), "edges")
        # All stars: no node is both an upper and a lower end, each upper end has one edge.
        open_ = nxt.select(F.col("v").alias("u")).distinct().join(
            nxt.select("u").distinct(), "u", "left_semi").limit(1).count()
        e = nxt
        if not open_:
            twice = e.groupBy("u").count().where("count > 1").limit(1).count()
            if not twice:
                break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

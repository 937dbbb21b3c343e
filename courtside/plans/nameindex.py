"""Name search over an inverted index.

``build`` folds every different player and team name once and writes two tables:
``names`` (``name, key``: the accent- and case-free form) and ``grams``
(``gram, key``: its parts of one, two and three characters), the latter sorted
by gram in its files and with Parquet bloom filters on it, so that a search reads only
the row groups that can hold its grams. Both grow with the different names,
not with the rows.

``search`` gives the same rows as :func:`courtside.plans.compare.search`: keys that
hold all three-character parts of the text (the text itself where it is
shorter) are candidates, ``contains`` decides, and the pool is joined to the
names that are left; no name of the pool is folded.

A text under two characters finds nothing; one of which nothing is left when
folded finds every row, as ``contains`` of an empty text does. A NULL name
has an empty key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.lake import read_table, write_table
from .compare import found_page

LAYER = "search"
SIZES = (1, 2, 3)


def grams_of(key: Column, size: int) -> Column:
    """The different parts of ``size`` characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(key) - (size - 1), F.lit(1)))
    parts = F.transform(starts, lambda i: F.substring(key, i, F.lit(size)))
    return F.array_distinct(F.filter(parts, lambda g: F.length(g) == size))


def build(players: DataFrame, root: str) -> dict[str, int]:
    """Write the index of ``players``' player and team names under ``root``; returns rows per table."""
    both = F.explode(F.array(F.coalesce("player_name", F.lit("")), F.coalesce("team", F.lit(""))))
    names = players.select("player_name", "team").distinct().select(both.alias("name")).distinct()
    rows = {"names": write_table(names.select("name", T.search_key(F.col("name")).alias("key")), root, LAYER, "names",
                                 partition_by=(), rebuild=True, sort_by=("key",))["rows"]}
    # From the written names: folded once.
    keys = read_table(players.sparkSession, root, LAYER, "names").select("key").distinct()
    every = F.flatten(F.array(*[grams_of(F.col("key"), n) for n in SIZES]))
    rows["grams"] = write_table(keys.select(F.explode(every).alias("gram"), "key"), root, LAYER, "grams",
                                partition_by=(), rebuild=True, sort_by=("gram", "key"),
                                options={"parquet.bloom.filter.enabled#gram": "true"})["rows"]
    return rows


def matching(spark: SparkSession, root: str, text: str) -> DataFrame:
    """``name``: the different names that contain ``text``, accents and case aside."""
    names = read_table(spark, root, LAYER, "names")
    needle = F.lit(text.strip())
    # A constant, folded by the optimizer: no job.
    key, *parts = spark.range(1).select(T.search_key(needle), *[grams_of(T.search_key(needle), n) for n in SIZES]).first()
    if not key:
        return names.select("name")
    wanted = parts[min(len(key), max(SIZES)) - 1]
    grams = read_table(spark, root, LAYER, "grams").where(F.col("gram").isin(wanted))
    candidates = grams.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return names.join(candidates.where(F.col("key").contains(key)), "key", "left_semi").select("name")


def search(pool: DataFrame, root: str, text: str, exclude: list[str] | None = None, limit: int = 8) -> DataFrame:
    """P14 over the index of the pool's names: first ``limit`` rows per context in the leaders order."""
    if len(text.strip()) < 2:
        return pool.limit(0)
    hits = matching(pool.sparkSession, root, text)
    marked = pool
    for column in ("player_name", "team"):
        named = hits.select(F.col("name").alias(f"_{column}"))
        marked = marked.join(named, F.coalesce(F.col(column), F.lit("")) == F.col(f"_{column}"), "left")
    found = marked.where("_player_name IS NOT NULL OR _team IS NOT NULL").drop("_player_name", "_team")
    return found_page(found, exclude, limit)

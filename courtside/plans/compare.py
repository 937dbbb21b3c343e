"""Player comparison (W05, A26), name search (P14), notebook questions
(A23-A25, T05)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import Context
from .context import CTX
from .league import eligible, page

# Radar axes: (output name, column of the leaders pool).
AXES = [("pts", "avg_pts"), ("reb", "avg_reb"), ("ast", "avg_ast"), ("stl", "avg_stl"),
        ("blk", "avg_blk"), ("ts", "ts_pct")]
# Comparison rows where higher is better: (metric, column).
BEST_ROWS = [("pts", "avg_pts"), ("reb", "avg_reb"), ("ast", "avg_ast"), ("stl", "avg_stl"),
             ("blk", "avg_blk"), ("val", "avg_val"), ("plus_minus", "avg_plus_minus"),
             ("t2", "t2_pct"), ("t3", "t3_pct"), ("ft", "ft_pct"), ("efg", "efg_pct"), ("ts", "ts_pct")]


def _long(df: DataFrame, axes, keys) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).cast("double").alias("value")) for a, c in axes])
    return df.select(*keys, F.inline(entries))


def percentiles(pool: DataFrame, rows: DataFrame | None = None, axes=AXES) -> DataFrame:
    """Percentile of each row's value in the pool of its context:
    share of non-null pool values <= value, x100, rounded; NULL value or
    empty pool -> NULL. Rows default to the pool itself.

    Counted per distinct value (an aggregate), then a running sum over the
    distinct values only, so no window holds a whole context's rows.
    """
    keys = [*CTX, "player_name"]
    pl = _long(pool, axes, keys).filter(F.col("value").isNotNull())
    counts = pl.groupBy(*CTX, "axis", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*CTX, "axis").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select(*CTX, "axis", "value", F.sum("n").over(w).alias("below"))
    totals = counts.groupBy(*CTX, "axis").agg(F.sum("n").alias("total"))
    target = _long(rows if rows is not None else pool, axes, keys)
    # Values found in the pool: an equi-join on the exact value. Values
    # not in the pool (players outside it): merged into the distinct pool
    # values and counted by a running sum, pool rows first on ties.
    exact = target.join(cum, [*CTX, "axis", "value"], "left")
    pct_of = (lambda below: F.when(F.col("value").isNull() | F.col("total").isNull(), F.lit(None))
              .otherwise(F.round(below / F.col("total") * 100, 0).cast("int")))
    if rows is None:  # every non-null value is a pool value: the exact join finds it
        d = exact.join(totals, [*CTX, "axis"], "left")
        return d.select(*keys, "axis", "value", pct_of(F.col("below")).alias("percentile"))
    outside = exact.filter(F.col("below").isNull() & F.col("value").isNotNull()).drop("below")
    merged = (counts.select(*CTX, "axis", "value", "n", F.lit(0).alias("_t"), F.lit(None).cast("string").alias("player_name"))
              .unionByName(outside.select(*CTX, "axis", "value", F.lit(0).cast("long").alias("n"),
                                          F.lit(1).alias("_t"), "player_name")))
    w2 = Window.partitionBy(*CTX, "axis").orderBy("value", "_t").rowsBetween(Window.unboundedPreceding, 0)
    lower = (merged.withColumn("below2", F.sum("n").over(w2)).filter(F.col("_t") == 1)
             .select(*keys, "axis", "value", "below2"))
    d = exact.join(lower, [*keys, "axis", "value"], "left").join(totals, [*CTX, "axis"], "left")
    below = F.coalesce(F.col("below"), F.col("below2"), F.lit(0))
    return d.select(*keys, "axis", "value", pct_of(below).alias("percentile"))


def compared(pool: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` players of each context's leaders order."""
    return page(pool, [F.desc("avg_val"), F.asc("player_name")], limit=n, partition=CTX)


def best_of(rows: DataFrame, metrics=BEST_ROWS) -> DataFrame:
    """Per context and metric, flag the compared players holding the
    best value; only when more than one player is compared."""
    keys = [*CTX, "player_name"]
    d = _long(rows, metrics, keys).withColumnRenamed("axis", "metric")
    w = Window.partitionBy(*CTX, "metric")
    d = d.withColumn("_max", F.max("value").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    return d.select(*keys, "metric", "value",
                    ((F.col("_n") > 1) & F.col("value").isNotNull() & (F.col("value") == F.col("_max"))).alias("is_best"))


def search(pool: DataFrame, text: str, exclude: list[str] | None = None, limit: int = 8) -> DataFrame:
    """Accent- and case-free substring of player or team name;
    at least 2 characters; excluded slugs dropped; first ``limit`` in the
    pool's order (leaders order) per context."""
    needle = text.strip()
    if len(needle) < 2:
        return pool.limit(0)
    key = F.lower(T.fold(F.lit(needle)))
    d = pool.filter(T.search_key(F.col("player_name")).contains(key) | T.search_key(F.col("team")).contains(key))
    return found_page(d, exclude, limit)


def found_page(found: DataFrame, exclude: list[str] | None, limit: int) -> DataFrame:
    """What a search found, without ``exclude``, in the leaders order."""
    if exclude:
        found = found.filter(~F.col("slug").isin(exclude))
    return page(found, [F.desc("avg_val"), F.asc("player_name")], limit=limit, partition=CTX)


def leader_pool(players: DataFrame, ctx: Context | None = None) -> DataFrame:
    return eligible(players, ctx)

"""Ordered operators that stay parallel when one key is huge.

A plain ``Window.partitionBy(game)`` puts a whole game in one task. If one
game (or user, or source) holds a third of all rows, that task holds a
third of the data. Every ordered step here is therefore split by a
*bucket*: a whole number that does not fall along the sort order (a second, or
``num div B``). Work per task is then bounded by the bucket's rows, and what
crosses the key-wide step is one row per bucket. Those carry rows are summed
in two levels themselves (blocks of ``CARRY`` buckets, then blocks), so a key
of n rows costs about n / B / CARRY rows in its longest window.

* ``sequence``    dense 1-based position in the order (row_number),
* ``running``     running sum / max from the first row (rows frame),
* ``next_row``    columns of the next row (lead 1),
* ``with_next``   the same where rows have a dense position, as an equi-join on
                  (key, position + 1) - no window at all.

A bucket's carry is one more row of it, so the rows are dealt once, by (key, bucket).
With ``whole`` the buckets are left out: for rows that lie dealt by key where no key is
large, as one window per key needs no further dealing there.

Each is exact: the same answer as the single window, on any partitioning.
Rows with a NULL key or order value are kept: NULL keys are one group, a
NULL bucket comes first.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__bucket"
_OFF = "__offset"
_CARRIED = "__carried"
CARRY = 4096


def _cols(xs) -> list:
    return [xs] if isinstance(xs, (str, Column)) else list(xs)


def bucket_of(seq: Column, size: int = 4096) -> Column:
    """A bucket for an integer position-like column."""
    return F.floor(seq / F.lit(size)).cast("long")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL (NULL equals NULL); keeps the left keys."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = c if on is None else on & c
    return left.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def _before(per_bucket: DataFrame, keys: list[str], parts: dict[str, str], agg, carry: int = CARRY) -> DataFrame:
    """Per (keys, bucket): ``agg`` of each part over all earlier buckets, NULL
    where there is none. Buckets (whole numbers) are cut into blocks of
    ``carry``; only blocks meet in a key-wide window."""
    # A NULL bucket is the smallest.
    block = F.coalesce(F.col(_B) - F.pmod(F.col(_B), F.lit(carry)), F.lit(-(1 << 63)))
    d = per_bucket.withColumn("__block", block)
    inner = Window.partitionBy(*keys, "__block").orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[agg(c).over(inner).alias(f"__in_{o}") for o, c in parts.items()])
    blocks = per_bucket.withColumn("__block", block).groupBy(*keys, "__block").agg(
        *[agg(c).alias(f"__p_{o}") for o, c in parts.items()])
    outer = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__block", *[agg(f"__p_{o}").over(outer).alias(f"__out_{o}") for o in parts])
    d = _same(d, blocks, [*keys, "__block"])
    return d.select(*keys, _B, *[_merge(F.col(f"__out_{o}"), F.col(f"__in_{o}"), agg).alias(o) for o in parts])


def _merge(a: Column, b: Column, agg) -> Column:
    """Aggregate of two parts, either of which may be missing."""
    both = F.greatest(a, b) if agg is F.max else a + b
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def sequence(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
             name: str = "seq", total: str | None = None, whole: bool = False) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, bucketed.

    ``bucket`` must not decrease along ``order`` within a key; ``order``
    must be a total order within the key (ties make any numbering valid,
    as with row_number). With ``total`` the key's row count comes along
    (from the bucket counts, no second pass over the rows).
    """
    keys = list(keys)
    if whole:
        of_key = Window.partitionBy(*keys)
        d = df.withColumn(name, F.row_number().over(of_key.orderBy(*_cols(order))).cast("long"))
        return d.withColumn(total, F.count(F.lit(1)).over(of_key)) if total else d
    d = df.withColumn(_B, bucket)
    counts = d.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__n"))
    offsets = _before(counts, keys, {_OFF: "__n"}, F.sum)
    if total:
        offsets = _same(offsets, counts.groupBy(*keys).agg(F.sum("__n").alias(total)), keys)
    d, within = _carried(d, offsets, keys, order)
    if total:
        d = d.withColumn(total, F.first(total).over(within))
    d = d.withColumn(name, (F.coalesce(F.first(_OFF).over(within), F.lit(0)) + F.row_number().over(within) - 1).cast("long"))
    return d.where(~F.col(_CARRIED)).drop(_B, _OFF, _CARRIED)


def _carried(d: DataFrame, carry: DataFrame, keys: list[str], order: Sequence):
    """Rows with one ``carry`` row per (keys, bucket) before them, and the window up to a row."""
    d = d.withColumn(_CARRIED, F.lit(False)).unionByName(carry.withColumn(_CARRIED, F.lit(True)), allowMissingColumns=True)
    return d, Window.partitionBy(*keys, _B).orderBy(F.col(_CARRIED).desc(), *_cols(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def running(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column,
            values: dict[str, Column], how: str = "max", carry: int = CARRY, whole: bool = False) -> DataFrame:
    """Running aggregate from the first row to the current row (inclusive).

    ``values`` maps output name -> input column; ``how`` is 'max' or 'sum';
    ``carry`` is the width of a block of bucket numbers, where these are not dense.
    """
    keys = list(keys)
    agg = {"max": F.max, "sum": F.sum}[how]
    if whole:
        so_far = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({o: agg(c).over(so_far) for o, c in values.items()})
    d = df.withColumn(_B, bucket)
    for out, col in values.items():
        d = d.withColumn("__v_" + out, col)
    per_bucket = d.groupBy(*keys, _B).agg(*[agg("__v_" + o).alias("__b_" + o) for o in values])
    before = _before(per_bucket, keys, {"__c_" + o: "__b_" + o for o in values}, agg, carry)
    d, within = _carried(d, before, keys, order)
    d = d.withColumns({o: _merge(F.first("__c_" + o).over(within), agg("__v_" + o).over(within), agg) for o in values})
    return d.where(~F.col(_CARRIED)).drop(_B, _CARRIED, *[f"__v_{o}" for o in values], *[f"__c_{o}" for o in values])


def next_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, cols: Sequence[str],
             name: str = "_next", carry: int = CARRY, whole: bool = False) -> DataFrame:
    """``lead(struct(cols), 1) over (partition by keys order by order)`` as ``name``, bucketed; ``bucket``
    and ``order`` as in :func:`sequence`. A bucket's carry is the first row of the bucket after it."""
    keys = list(keys)
    if whole:
        return df.withColumn(name, F.lead(F.struct(*cols)).over(Window.partitionBy(*keys).orderBy(*order)))
    d = df.withColumn(_B, bucket)
    block = F.coalesce(F.col(_B) - F.pmod(F.col(_B), F.lit(carry)), F.lit(-(1 << 63)))
    firsts = d.groupBy(*keys, _B).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__first")).withColumn("__block", block)
    blocks = firsts.groupBy(*keys, "__block").agg(F.min_by("__first", F.struct(_B)).alias("__first"))
    blocks = blocks.select(*keys, "__block", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__block")).alias("__out"))
    inside = firsts.withColumn("__in", F.lead("__first").over(Window.partitionBy(*keys, "__block").orderBy(_B)))
    after = _same(inside, blocks, [*keys, "__block"]).select(*keys, _B, F.coalesce("__in", "__out").alias("__after"))
    after = after.where(F.col("__after").isNotNull()).select(*keys, _B, "__after.*", F.lit(True).alias(_CARRIED))
    d = d.withColumn(_CARRIED, F.lit(False)).unionByName(after, allowMissingColumns=True)
    within = Window.partitionBy(*keys, _B).orderBy(_CARRIED, *order)
    d = d.withColumn(name, F.lead(F.struct(*cols)).over(within))
    return d.where(~F.col(_CARRIED)).drop(_B, _CARRIED)


def with_next(df: DataFrame, keys: Sequence[str], seq: str, cols: dict[str, str | Column]) -> DataFrame:
    """``lead(col, 1) over (partition by keys order by seq)`` for dense ``seq``.

    ``cols`` maps output name -> source column. An equi-join on
    (keys, seq + 1): hash-partitioned on the position too, so a hot key is
    spread over all tasks.
    """
    keys = list(keys)
    nxt = df.select(*keys, (F.col(seq) - 1).alias(seq),
                    *[(F.col(src) if isinstance(src, str) else src).alias(out) for out, src in cols.items()])
    return _same(df, nxt, keys + [seq], "left")

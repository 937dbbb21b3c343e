"""presentation of answers.

Questions return unrounded doubles; this one step rounds them the way the
answers are shown (per-game values to 1 digit, ratios to 4, distances and
coordinates to 2) and can pack a row into nested JSON.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATIO_MARKERS = ("_pct", "pct_")
TWO_DIGITS = ("x", "y", "shot_distance_m", "fouls_per_game")


def present(df: DataFrame) -> DataFrame:
    """Round every double column by its kind; other columns unchanged."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            if any(m in f.name for m in RATIO_MARKERS):
                c = F.round(c, 4)
            elif f.name in TWO_DIGITS:
                c = F.round(c, 2)
            else:
                c = F.round(c, 1)
        out.append(c.alias(f.name))
    return df.select(*out)


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys kept as columns, the rest as one JSON document column."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias("answer"))

"""Quality rules: fixed rules first, then boosted trees over document statistics.

Words are what white space of ASCII separates. A document fails a base rule
if it has too few words or repeats too much of itself; the others are judged
by gradient-boosted trees (:mod:`boosting`) over statistics of the whole text,
monotonic in the chosen ones (``FALLING``: more of it never helps).

The trees are fitted on a bounded sample of the labelled rows: equal rows
count as one with a weight, and of either label at most ``sample_rows`` are
taken, those with the smallest hash of their statistics. All else covers all
documents.

Defined cases: a null text has no words (and fails for that); labels with a
null id or a quality other than 0 or 1 are ignored; without labels of both
classes the base rules alone decide; repeated rows keep one output row each;
an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .common import bound_batches, text_or_empty, written

SYMBOLS = "#*$%&|<>"  # fixed value: the characters counted as symbols
SPACES = " \t\n\v\f\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "word_len", "symbols", "dup_lines", "repeats", "distinct", "top_word", "lines", "line_words", "upper",
            "digits", "ends", "odd_ends", "bangs", "bars", "accents"]
FALLING = ("symbols", "dup_lines", "repeats", "bangs")


def repeated_words(words: list, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    key = ids[:n]
    for i in range(1, width):
        if len(seen) ** 2 >= 1 << 31:  # keep codes small enough to be combined exactly
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(seen) + ids[i:n + i]
    _, code, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[code] > 1
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, np.flatnonzero(twice), 1)
    np.add.at(mark, np.flatnonzero(twice) + width, -1)
    return int((mark.cumsum()[:-1] > 0).sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """Base counts and features of one whole text, in the order of ``BASE`` and ``FEATURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: ASCII white space only
    n = len(words)
    count = text.count
    chars = len(text) - sum(map(count, SPACES))
    symbols = sum(map(count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return [0, chars, symbols, dup, 0], [0.0] * len(FEATURES)
    seen = Counter(words)
    odd = ends = 0
    for w, k in seen.items():
        c = w[-1:]
        if c in b".?":
            ends += k
        elif c < b"0" and c not in b",;:)\"'":
            odd += k
    upper = len(raw) - len(raw.translate(None, UPPER))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    feats = [math.log1p(n), chars / n, symbols / n, dup / len(lines), repeats / n, len(seen) / n, max(seen.values()) / n,
             math.log1p(len(lines)), math.log1p(n / len(lines)), upper / chars, digits / chars, ends / n, odd / n,
             count("!") / n, count("|") / n, (len(raw) - len(text)) / chars]
    return [n, chars, symbols, dup, repeats], feats


UPPER = bytes(range(65, 91))


def with_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts and ``x`` (array<double>) of every row."""
    bound_batches(docs.sparkSession)
    src = docs.select("doc_id", text_or_empty("text").alias("text"))
    schema = src.select("doc_id").schema
    for c in BASE:
        schema = schema.add(c, "long")
    schema = schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches):
        for b in batches:
            got = [measure(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array([g[0][i] for g in got], pa.int64()) for i in range(len(BASE))]
                + [pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["doc_id", *BASE, "x"])

    return src.mapInArrow(run, schema)


def sample(stats: DataFrame, labels: DataFrame, train: Column, sample_rows: int, buckets: int = 1024) -> list:
    """At most ``sample_rows`` weighted rows ``(x, y, n)`` of either label.

    Rows are dealt to hash buckets; as many buckets of a label are taken as
    hold no more than the bound, so tasks send only what is used.
    """
    good = labels.where(train & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    rows = stats.join(good.select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    rows = written(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "rules-labelled")
    out = []
    for y, n in rows.groupBy("y").count().collect():  # two rows
        # About the bound's number of rows lies in the first ``buckets`` of these.
        spread = buckets * max(1, math.ceil(n / sample_rows))
        own = rows.where(F.col("y") == y).withColumn("bucket", F.pmod(F.xxhash64("x"), F.lit(spread)))
        held, last = 0, -1
        sizes = {r.bucket: r["count"] for r in own.where(F.col("bucket") < buckets).groupBy("bucket").count().collect()}
        for b in range(buckets):
            held += sizes.get(b, 0)
            if held > sample_rows:
                break
            last = b
        out += own.where(F.col("bucket") <= last).select("x", "y", "n").collect()
    return sorted(out)


def learn(stats: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 10_000) -> boosting.Trees | None:
    """Trees fitted on at most ``sample_rows`` rows of either label; None without both labels."""
    rows = sample(stats, labels, train, sample_rows)
    y = np.array([r.y for r in rows], dtype=float)
    if len(set(y)) < 2:
        return None
    x, n = np.array([r.x for r in rows]), np.array([r.n for r in rows], dtype=float)
    # A text with very many copies shall not outvote all others.
    return boosting.fit(x, y, np.sqrt(n), {FEATURES.index(f): -1 for f in FALLING})


def judged(stats: DataFrame, model: boosting.Trees | None, min_words: int, max_repeats: int, threshold: float) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``score`` (null without a model) and ``kept``."""
    keep = ["doc_id", *BASE]
    schema = stats.select(*keep).schema.add("score", "double")

    def run(batches):
        for b in batches:
            x = b.column(len(keep))
            score = None
            if model is not None:
                score = model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))]
                + [pa.nulls(b.num_rows, pa.float64()) if score is None else pa.array(score)], names=[*keep, "score"])

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeats * F.col("n_words"))
    return stats.select(*keep, "x").mapInArrow(run, schema).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(1.0)) >= threshold))


def judge(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = 10_000, min_words: int = 50,
          max_repeats: int = 50, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``kept`` and ``score`` of every row of ``docs``."""
    stats = written(with_counts(docs), "rules-counts")
    return judged(stats, learn(stats, labels, train, sample_rows), min_words, max_repeats, threshold).select(
        "doc_id", *BASE, "base_failed", "kept", "score")

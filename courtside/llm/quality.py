"""Quality classifier: regularised quadratic discriminant on document statistics.

Every document becomes a short vector of transformed statistics (lengths,
shares of character kinds, repetition). Per class the mean and covariance come
from sums over all labelled training rows, aggregated by Spark; the
covariance is shrunk towards the pooled one and towards a multiple of the
identity. A score is the logistic of the difference of the two Gaussian
log-densities (Mahalanobis distances through Cholesky factors that are
computed once and cached in the task) plus the log prior odds, scaled by a
temperature fitted on the training rows' own margins.

Defined cases: null text counts as empty and is scored like any text;
labels with a null id or a quality other than 0 or 1 are ignored, a label row
counts as often as it is given; without labels of both classes the score is
the smoothed share of label 1 (0.5 without any); repeated rows keep one output
row each; an empty table gives an empty table; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, text_or_empty, written

FEATURES = ["chars", "words", "word_len", "long_words", "lines", "line_words", "upper", "digit", "space", "accent",
            "mark", "stop", "comma", "bang", "bar", "odd_ends", "distinct_words", "top_word", "distinct_lines",
            "distinct_pairs", "capital_words"]
D = len(FEATURES)


def _share(part: float, whole: float) -> float:
    """Share, stretched near 0 and 1 (arcsine of the root): closer to a normal spread."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text, in the order of ``FEATURES``."""
    n = len(text)
    words = text.split()
    w = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    upper = digit = space = accent = mark = letters = 0
    for c in set(text):
        k = text.count(c)
        if c.isalpha():
            letters += k
            upper += k * c.isupper()
            accent += k * (c > "\x7f")
        elif c.isdigit():
            digit += k
        elif c.isspace():
            space += k
        else:
            mark += k
    odd, long_, capital = 0, 0, 0
    for x, k in seen.items():
        odd += k * (not x[-1].isalnum() and x[-1] not in ".,;:")
        long_ += k * (len(x) > 12)
        capital += k * x.isupper()
    count = text.count
    return [
        math.log1p(n), math.log1p(w), math.log1p(letters / w) if w else 0.0, _share(long_, w),
        math.log1p(len(lines)), math.log1p(w / len(lines)) if lines else 0.0, _share(upper, n), _share(digit, n),
        _share(space, n), _share(accent, n), _share(mark, n), _share(count(".") + count("?"), n),
        _share(count(","), n), _share(count("!"), n), _share(count("|"), n), _share(odd, w), _share(len(seen), w),
        _share(max(seen.values(), default=0), w), _share(len(set(lines)), len(lines)),
        _share(len(set(zip(words, words[1:]))), w - 1) if w > 1 else math.pi / 2, _share(capital, w),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians by mean and Cholesky factor of the inverse-free kind:
    the squared Mahalanobis distance is |L^-1 (x - mean)|^2."""
    means: np.ndarray  # (2, D)
    factors: np.ndarray  # (2, D, D), lower triangular L with L L' = covariance
    priors: tuple[float, float]
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density difference, class 1 minus class 0, plus the log prior odds."""
        if len(self.means) == 0:
            return np.full(len(x), math.log(self.priors[1] / self.priors[0]))
        dens = []
        for m, low, p in zip(self.means, self.factors, self.priors):
            z = np.linalg.solve(low, (x - m).T)
            dens.append(math.log(p) - np.log(np.diag(low)).sum() - 0.5 * (z ** 2).sum(axis=0))
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        a = np.clip(self.slope * self.margin(x) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-a))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.2,
        to_identity: float = 0.02) -> Discriminant:
    """From (count, sum x, sum x x') per class. ``to_pooled`` and ``to_identity``
    are the shrinkage weights of the pooled covariance and of its mean variance."""
    n = [sums[c][0] if c in sums else 0.0 for c in (0, 1)]
    priors = ((n[0] + 1) / (sum(n) + 2), (n[1] + 1) / (sum(n) + 2))
    if min(n) == 0:
        return Discriminant(np.zeros((0, D)), np.zeros((0, D, D)), priors)
    means = [sums[c][1] / n[c] for c in (0, 1)]
    scatter = [sums[c][2] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / sum(n)
    floor = np.eye(D) * max(np.trace(pooled) / D, 1e-6)
    factors = []
    for c in (0, 1):
        # Fewer rows than statistics say little about a covariance: lean on the pooled one.
        a = max(to_pooled, D / (n[c] + D))
        cov = (1 - a) * scatter[c] / n[c] + a * pooled
        factors.append(np.linalg.cholesky((1 - to_identity) * cov + to_identity * floor))
    return Discriminant(np.array(means), np.array(factors), priors)


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``x`` (array<double>, the document's statistics)."""
    bound_batches(docs.sparkSession)
    src = docs.select(*keep, text_or_empty("text").alias("_text"))
    schema = src.drop("_text").schema.add("x", T.ArrayType(T.DoubleType()))
    last = len(keep)

    def run(batches):
        for b in batches:
            x = pa.array([statistics(t) for t in b.column(last).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(last)] + [x], names=[*keep, "x"])

    return src.mapInArrow(run, schema)


def _labelled(stats: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    good = labels.where(train & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    return stats.join(good.select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id").select("x", "y")


def learn(stats: DataFrame, labels: DataFrame, train: Column, bins: int = 400) -> Discriminant:
    """Fit on all labelled rows that ``train`` (a condition on labels) admits.

    ``stats`` has ``doc_id`` and ``x``. Tasks return sums of at most D x D
    numbers per class, and counts of margins in ``bins`` bins for the
    temperature, whatever the number of rows.
    """
    rows = written(_labelled(stats, labels, train), "labelled")

    def sums(batches):
        got: dict[int, list] = {}
        for b in batches:
            x, y = np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, D), b.column(1).to_numpy(False)
            for c in (0, 1):
                part = x[y == c]
                if len(part):
                    s = got.setdefault(c, [0.0, np.zeros(D), np.zeros((D, D))])
                    s[0] += len(part)
                    s[1] += part.sum(axis=0)
                    s[2] += part.T @ part
        for c, (n, a, q) in got.items():
            flat = np.concatenate([[n], a, q.ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(flat), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)],
                names=["y", "i", "v"])

    flat = rows.mapInArrow(sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    by: dict[int, np.ndarray] = {}
    for r in flat:  # 2 x (1 + D + D x D) numbers
        by.setdefault(r.y, np.zeros(1 + D + D * D))[r.i] = r.v
    model = fit({c: (v[0], v[1:1 + D], v[1 + D:].reshape(D, D)) for c, v in by.items()})
    if len(model.means) == 0:
        return model

    def margins(batches):
        for b in batches:
            m = model.margin(np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, D))
            at = np.clip(np.floor(np.arcsinh(m) / 10 * (bins // 2)), -bins // 2, bins // 2)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(1)], names=["bin", "y"])

    hist = rows.mapInArrow(margins, "bin int, y int").groupBy("bin", "y").count().collect()
    centre = np.array([math.sinh((r.bin + 0.5) * 10 / (bins // 2)) for r in hist])
    y, k = np.array([r.y for r in hist]), np.array([r["count"] for r in hist], dtype=float)
    slope, shift = temperature(centre, y, k)
    return Discriminant(model.means, model.factors, model.priors, slope, shift)


def temperature(m: np.ndarray, y: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift of margins ``m`` with labels ``y`` and counts
    ``k`` (Newton steps, slightly regularised towards slope 1, shift 0)."""
    m = np.clip(m, -50, 50)
    ab = np.array([1.0, 0.0])
    x = np.stack([m, np.ones_like(m)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        grad = x @ (k * (p - y)) + 1e-1 * (ab - [1.0, 0.0])
        hess = (x * (k * p * (1 - p))) @ x.T + 1e-1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab = ab - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``stats`` without ``x``, with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    keep = [c for c in stats.columns if c != "x"]
    schema = stats.select(*keep).schema.add("score", "double")

    def run(batches):
        for b in batches:
            s = model.score(np.array(b.column(len(keep)).to_pylist(), dtype=float).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(s)],
                                             names=[*keep, "score"])

    return stats.select(*keep, "x").mapInArrow(run, schema).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row of ``docs``."""
    stats = written(with_statistics(docs), "quality-statistics")
    return scored(stats, learn(stats, labels, train))


def keep_good(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, columns as given.

    One pass over the texts computes the statistics, a second filters them,
    so no text crosses a shuffle.
    """
    cols = tuple(docs.columns)
    model = learn(written(with_statistics(docs), "quality-statistics"), labels, train)
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([statistics(t or "") for t in b.column(at).to_pylist()], dtype=float).reshape(-1, D)
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.select(*cols).mapInArrow(run, docs.schema)

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import boosting, rules

SCHEMA = "doc_id long, text string, score double, x string"
WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    marked = set()
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    at = {}
    for i, w in enumerate(windows):
        at.setdefault(w, []).append(i)
    for where in at.values():
        if len(where) > 1:
            marked |= {j for i in where for j in (i, i + 1, i + 2)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


TEXTS = ["", " \n\t", "a", "a a", "a a a", "a a a a", "a b c a b c", "a b c d a b c x a b c", "x\n\nx\n x\nx", "é# * $\x0b%\x0c&\x1c|<>\x85  ß",
         "one two three\none two three\r\none two three", "w " * 3000, " ".join(map(str, range(5000))) + " 1 2 3", "x" * 200_000, None]


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_base_counts_as_stated(text):
    assert rules.measure(text)[0] == brute(text)


def test_windows_of_many_different_words():
    """More distinct words than codes of one window hold: the same count."""
    rnd = random.Random(1)
    words = [str(i) for i in range(60_000)] + [str(rnd.randrange(60_000)) for _ in range(500)] + ["1", "2", "3", "4"]
    assert rules.repeated_words(words) == brute(" ".join(words))[4]


def stats_rows(n, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.random((n, 4))
    y = ((x[:, 0] > 0.6) | (x[:, 1] + 0.2 * rnd.normal(size=n) > 0.7)).astype(float)
    return x, y


def test_trees_learn_and_flat_arrays_score_like_a_walk():
    x, y = stats_rows(3000, 1)
    model = boosting.fit(x, y, np.ones(len(y)), {}, trees=30)
    hx, hy = stats_rows(1000, 2)
    # As good as the rule that made the labels, which are noisy.
    rule = (((hx[:, 0] > 0.6) | (hx[:, 1] > 0.7)) == (hy == 1)).mean()
    assert ((model.score(hx) >= 0.5) == (hy == 1)).mean() > rule - 0.02
    for row, got in zip(hx[:50], model.margin(hx[:50])):
        total = model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        assert abs(total - got) < 1e-9


def test_monotonic_constraints_hold():
    x, y = stats_rows(2000, 3)
    y = np.where(np.random.default_rng(5).random(len(y)) < 0.2, 1 - y, y)
    model = boosting.fit(x, y, np.ones(len(y)), {0: -1, 1: 1}, trees=40, depth=4)
    free = boosting.fit(x, y, np.ones(len(y)), {}, trees=40, depth=4)
    grid = np.linspace(0, 1, 101)
    rows = np.random.default_rng(6).random((100, 4))

    def along(m, j):
        out = []
        for v in grid:
            r = rows.copy()
            r[:, j] = v
            out.append(m.margin(r))
        return np.diff(np.array(out), axis=0)
    assert along(model, 0).max() <= 1e-9 and along(model, 1).min() >= -1e-9
    assert along(free, 0).max() > 0.1 and along(free, 1).min() < -1e-3
    assert np.abs(along(model, 1)).max() > 0.1


def test_one_label_or_none():
    x, _ = stats_rows(50, 4)
    for y in (np.zeros(50), np.ones(50)):
        m = boosting.fit(x, y, np.ones(50), {})
        assert len(set(m.score(x))) == 1 and (m.score(x) >= 0.5).all() == bool(y[0])


def test_cases(llm_spark):
    rows = [(i, t, 9.0, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", 1.0, "x")] * 2
    docs = llm_spark.createDataFrame(rows, SCHEMA)
    labels = llm_spark.createDataFrame([(1, 1, "a"), (2, None, "b"), (None, 0, "c"), (3, 5, "d")], "doc_id long, quality int, x string")
    out = rules.judge(docs, labels, F.lit(True)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(TEXTS):
        r, b = by[i], brute(t)
        assert [r[c] for c in rules.BASE] == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and r.kept == (not r.base_failed)
    assert rules.judge(docs.limit(0), labels, F.lit(True)).count() == 0


def test_sample_is_bounded_and_takes_all_below_the_bound(llm_spark):
    stats = llm_spark.range(5000).select(F.col("id").alias("doc_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    stats = stats.unionByName(stats.where("doc_id < 10"))
    labels = llm_spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("quality"))
    few = rules.sample(stats, labels, F.lit(True), 400)
    count = [sum(r.y == y for r in few) for y in (0, 1)]
    assert all(300 < c <= 400 for c in count)
    every = rules.sample(stats, labels, F.lit(True), 10_000)
    assert len(every) == 5000 and sum(r.n for r in every) == 5010
    assert rules.sample(stats, labels, F.lit(True), 400) == few


def test_held_out_labels(llm_spark):
    from courtside.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    labels = llm_spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL")
    out = QUERIES["op13_quality_rules"](llm_spark, sf)
    rows = out.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).where("NOT base_failed").collect()
    assert len(rows) > 50 and np.mean([r.kept == (r.quality == 1) for r in rows]) >= 0.95
    assert np.mean([r.kept for r in rows if r.quality == 1]) >= 0.97

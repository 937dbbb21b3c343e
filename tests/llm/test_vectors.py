import random

import numpy as np
import pyarrow as pa
import pytest

from courtside.llm import topk, vptree
from courtside.llm.queries import ORACLE

from .conftest import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, v string, shard int"


def made(n, dim, seed=0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(dim)], 0, "x", 1) for i in range(n)]
    rows += [(n + i, rows[0][1], 0, "x", 1) for i in range(n // 3)]  # a hot vector
    rows += [rows[0], rows[2], (None, rows[1][1], 0, "x", 1), (9001, None, 0, "x", 1), (9002, [None] * dim, 0, "x", 1),
             (9003, [float("nan")] * dim, 0, "x", 1), (9004, [float("inf")] * dim, 0, "x", 1),
             (9005, [0.0] * dim, 0, "x", 1), (9006, [1.0] * (dim + 1), 0, "x", 1), (9050, [2.0] * (dim + 1), 0, "x", 1)]
    return rows


def brute(rows, step, k, score, zero):
    vec = {}
    for i, e, *_ in rows:
        if i is None or e is None or any(x is None or not np.isfinite(x) for x in e) or (zero and not any(e)):
            continue
        e = tuple(np.float32(x).astype(float) for x in e)
        vec[i] = min(vec.get(i, e), e)
    out = []
    for q in sorted(i for i in vec if i % step == 0):
        c = sorted((score(np.array(vec[q]), np.array(e)), i) for i, e in vec.items()
                   if i != q and len(e) == len(vec[q]))[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(c)]
    return out


@pytest.mark.parametrize("n,dim", [(400, 8), (3, 4)])
def test_exact_top_products(llm_spark, n, dim):
    rows = made(n, dim)
    v = topk.integer_vectors(llm_spark.createDataFrame(rows, SCHEMA))
    got = topk.top_products(v, v.where("vec_id % 50 = 0"), 5, pivots=8, shard_rows=150, block_rows=4)
    want = [(q, r, i, -s) for q, r, i, s in brute(
        rows, 50, 5, lambda a, b: -int(np.floor(256 * a) @ np.floor(256 * b)), False)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(want)


def test_top_products_sql(llm_spark, oracle):
    rows = [r for r in made(120, 6, 1) if r[1] is None or len(r[1]) == 6]
    v = topk.integer_vectors(llm_spark.createDataFrame(rows, SCHEMA))
    t = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()),
                  "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    assert rows_of(topk.top_products(v, v.where("vec_id % 50 = 0"), 5)) == oracle(ORACLE["op2_pivot_topk"], embeddings=t)


def test_products_beyond_exact_doubles(llm_spark):
    rows = [(0, [3e30, 1.0], 0, "", 0), (1, [3e30, 2.0], 0, "", 0), (2, [-3e30, 0.0], 0, "", 0), (3, [1e-3, 5e9], 0, "", 0)]
    v = topk.integer_vectors(llm_spark.createDataFrame(rows, SCHEMA))
    got = [(r.vec_id, r.score) for r in topk.top_products(v, v.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert [g[0] for g in got] == [1, 3, 2] and got[0][1] == 2 ** 63 - 1 and got[2][1] == -2 ** 63


@pytest.mark.parametrize("n,dim", [(400, 8), (3, 4)])
def test_factor_one_is_exact(llm_spark, n, dim):
    rows = made(n, dim)
    v = vptree.vectors(llm_spark.createDataFrame(rows, SCHEMA))
    got = vptree.nearest(v, v.where("vec_id % 100 = 0"), 10, factor=1.0, leaf=16, shard_rows=150, block_rows=2)
    want = brute(rows, 100, 10, lambda a, b: float(np.sqrt(((b - a) ** 2).sum())), True)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(want)


def test_recall_on_the_embeddings_table(llm_spark):
    v = vptree.vectors(llm_spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    q = v.where("vec_id % 100 = 0")
    exact = {(r.query_id, r.vec_id) for r in vptree.nearest(v, q, 10, factor=1.0, leaf=16).collect()}
    found = {(r.query_id, r.vec_id) for r in vptree.nearest(v, q, 10, factor=2.0, leaf=16).collect()}
    assert len(exact) == 50 and len(exact & found) >= 0.9 * len(exact)


def test_pruning_skips_leaves():
    """Clustered points: the tree must not look at all of them."""
    rnd = np.random.default_rng(1)
    x = np.repeat(rnd.normal(size=(20, 16)) * 50, 50, axis=0) + rnd.normal(size=(1000, 16))
    tree = vptree.build_tree(np.arange(1000), x, 32)
    seen = []
    real = vptree.distances
    vptree.distances = lambda a, b: (seen.append(len(a)), real(a, b))[1]
    try:
        vptree.nearest_in_shard(tree, np.array([0]), x[:1], 10, 1.0)
    finally:
        vptree.distances = real
    assert sum(seen) < 500


def test_empty_tables(llm_spark):
    e = llm_spark.createDataFrame([], SCHEMA)
    v = topk.integer_vectors(e)
    assert topk.top_products(v, v, 5).count() == 0
    w = vptree.vectors(e)
    assert vptree.nearest(w, w, 10).count() == 0

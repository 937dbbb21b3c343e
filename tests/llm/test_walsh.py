import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from courtside.llm import walsh

from .conftest import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int"


def brute(x, ids, k, rounds, salt):
    """Plain Python integers, every distance in full."""
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"{salt}:{ids[i]}".encode()).hexdigest(), x[i]))
    cents = [x[i] for i in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        to = [nearest(v)[1] for v in x]
        for j in range(len(cents)):
            own = [v for v, c in zip(x, to) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    got = [nearest(v) for v in x]
    return sorted((i, c, d) for i, (d, c) in zip(ids, got)), cents


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9) for i, v in rows], SCHEMA)


def test_transform_is_the_matrix_and_keeps_distances():
    h = np.array([[1]])
    while len(h) < 64:
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(1).integers(-1000, 1000, (7, 64))
    assert (walsh.transform(x) == x @ h.T).all()
    d = walsh.transform(x[:1]) - walsh.transform(x[1:2])
    assert (d ** 2).sum() == 64 * ((x[0] - x[1]) ** 2).sum()
    changes = (np.diff(h[walsh.ORDER], axis=1) != 0).sum(axis=1)
    assert list(changes) == sorted(changes)


@pytest.mark.parametrize("scale", [3, 300, 1 << 24, 1 << 40])
def test_search_is_exact_and_eliminates(scale):
    rnd = np.random.default_rng(2)
    smooth = rnd.integers(-scale, scale, (40, 64)).cumsum(axis=1) // 8
    x = np.concatenate([smooth + rnd.integers(-2, 3, smooth.shape), smooth, smooth[:5]])
    cents = np.concatenate([smooth[5:], smooth[:5], smooth[:5]])
    to, dist, work = walsh.search(x, cents)
    full = ((x.astype(object)[:, None] - cents.astype(object)[None]) ** 2).sum(axis=2)
    assert [int(c) for c in to] == [min(range(len(cents)), key=lambda c: (row[c], c)) for row in full]
    assert [int(d) for d in dist] == [int(min(row)) for row in full]
    if scale > 3:
        assert work < len(x) * len(cents) * 64 / 2


def test_same_as_plain_integers(llm_spark):
    rnd = np.random.default_rng(3)
    rows = [(int(i), rnd.normal(size=64).astype("float32").tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[0][1]), (100, None), (101, rows[0][1][:63]), (102, [None] + rows[0][1][1:]),
             (103, [math.nan] + rows[0][1][1:]), (104, [math.inf] + rows[0][1][1:]), (105, []), (106, rows[0][1] * 2), (107, [0.0] * 64)]
    ok = [(i, v) for i, v in rows if i is not None and i not in range(100, 107)]
    ints = [[math.floor(256 * x) for x in v] for _, v in ok]
    for k in (5, 40, 100):
        want, cents = brute(ints, [i for i, _ in ok], k, 5, 2)
        out = walsh.clustering(frame(llm_spark, rows), k=k).collect()
        assert sorted((r.vec_id, r.cluster, r.distance) for r in out) == want
        sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
        per = {}
        for _, c, d in want:
            per[c] = per.get(c, 0) + d
        assert all((r.centroid_sha256, r.cluster_inertia, r.inertia) == (sha[r.cluster], per[r.cluster], sum(per.values())) for r in out)


def test_huge_components(llm_spark):
    rnd = np.random.default_rng(4)
    rows = [(int(i), (rnd.normal(size=64) * 10.0 ** (i % 39)).astype("float32").tolist()) for i in range(50)]
    ints = [[math.floor(256 * x) for x in v] for _, v in rows]
    want, _ = brute(ints, [i for i, _ in rows], 4, 5, 2)
    out = walsh.clustering(frame(llm_spark, rows), k=4).collect()
    fits = lambda v: v if v < 1 << 63 else None
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out) == [(i, c, fits(d)) for i, c, d in want] or (
        {(r.vec_id, r.cluster) for r in out} == {(i, c) for i, c, _ in want})
    assert {r.vec_id: r.distance for r in out} == {i: fits(d) for i, _, d in want}


def test_integers_round_down():
    got = walsh.integers(pa.array([[-0.001] + [0.5] * 63], pa.list_(pa.float32())))
    assert list(got[0][:2]) == [-1, 128]


def test_empty(llm_spark):
    assert walsh.clustering(frame(llm_spark, [])).count() == 0
    assert walsh.clustering(frame(llm_spark, [(1, None)])).count() == 0


def test_same_as_sql(llm_spark, oracle):
    from courtside.llm.queries import ORACLE, QUERIES
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.001"
    table = pq.read_table(f"{sf}/embeddings.parquet")
    assert rows_of(QUERIES["op12_walsh_clusters"](llm_spark, sf)) == oracle(ORACLE["op12_walsh_clusters"], embeddings=table)

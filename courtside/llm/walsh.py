"""Centroid clustering with exact Walsh-Hadamard progressive search.

Vectors of 64 components become integers, floor(256 x), and go through the
64-point Walsh-Hadamard transform (additions only, so exact). The transform
keeps distances up to the factor 64: the sum of squared coefficient
differences is 64 times the squared distance. A search sums the differences
coarse to fine (by sequency, in blocks): what is summed so far is a lower
bound. The centroid that leads after the first block is finished to get an upper
bound; in every later block centroids whose sum is strictly above it go, and
what is left at the end has all 64 coefficients and the exact distance.

Components beyond 2^24 (a whole batch of them, or a centroid) are handled with
Python's unbounded integers, all others with 64-bit ones, where 64 times a
distance stays below 2^63. A distance or inertia that no long holds is null.

Defined cases: a row takes part if its vec_id is not null and its vector has
exactly 64 components, none null or non-finite; every such row is a vector of
its own, repeated ids included (seeds of one id: the smaller vector first);
fewer vectors than centroids: as many centroids as vectors; none: an empty
table; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written

DIM = 64
SAFE = 1 << 24  # components up to here are exact in 64-bit integers
LONG = (1 << 63) - 1
LIMB = 44  # bits of a limb of a sum
BLOCKS = [(0, 4), (4, 8), (8, 16), (16, 32), (32, 64)]


def sequency() -> np.ndarray:
    """Rows of the butterfly's transform by their number of sign changes, coarse to fine."""
    h = transform(np.eye(DIM, dtype=np.int64))
    return np.argsort((np.diff(h, axis=0) != 0).sum(axis=0), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (natural order), by butterflies."""
    x = x.copy()
    step = 1
    while step < DIM:
        y = x.reshape(len(x), -1, 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), DIM)
        step *= 2
    return x


ORDER = sequency()


def search(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row (ties: the smaller number), the squared
    distance, and how many coefficient differences were summed."""
    if max(_largest(x), _largest(centroids)) > SAFE:
        x, centroids = x.astype(object), centroids.astype(object)
    wx, wc = transform(x)[:, ORDER], transform(centroids)[:, ORDER]
    n, k = len(x), len(centroids)

    def part(rows, cents, block):
        a, b = block
        return ((wx[rows, a:b] - wc[cents, a:b]) ** 2).sum(axis=1)

    rows, cents = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = part(rows, cents, BLOCKS[0])
    lead = total.reshape(n, k).argmin(axis=1)
    every = np.arange(n)
    best = sum(part(every, lead, block) for block in BLOCKS)  # exact, of the leading centroid
    work = n * k * 4 + n * DIM
    for block in BLOCKS[1:]:
        live = total <= best[rows]
        rows, cents, total = rows[live], cents[live], total[live]
        total = total + part(rows, cents, block)
        work += len(rows) * (block[1] - block[0])
    # Smallest total first, then the smaller number; the leader itself is always left.
    first = np.lexsort((cents, total, rows)) if total.dtype != object else np.array(
        sorted(range(len(rows)), key=lambda i: (rows[i], total[i], cents[i])), dtype=int)
    _, at = np.unique(rows[first], return_index=True)
    pick = first[at]
    return cents[pick], total[pick] // DIM, work


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def integers(vectors: pa.Array) -> np.ndarray:
    """Rows of floor(256 x); unbounded integers where 64 bits do not hold them."""
    flat = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if flat.size and not np.isfinite(flat).all() or flat.size and np.abs(flat).max() > SAFE:
        exact = vectors.flatten().to_pylist()
        return np.array([math.floor(float(v) * 256 if abs(v) < 1e300 else int(v) * 256) for v in exact],
                        dtype=object).reshape(-1, DIM)
    return flat.astype(np.int64).reshape(-1, DIM)


def vectors(df: DataFrame) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) == DIM) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return df.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def seeds(rows: DataFrame, k: int, salt: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    got = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()  # k rows
    return integers(pa.array([r.v for r in got], pa.list_(pa.float64())))


def _sums(rows: DataFrame, centroids: np.ndarray) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Vectors and component sums per cluster. A task sends k x 64 numbers (sums in
    limbs of 44 bits where they are large); Spark adds them."""

    def run(batches):
        count, total = [0] * len(centroids), [np.zeros(DIM, dtype=object) for _ in centroids]
        for b in batches:
            x = integers(b.column(0))
            if not len(x):
                continue
            to = search(x, centroids)[0]
            for c in np.unique(to):
                count[c] += int((to == c).sum())
                total[c] = total[c] + x[to == c].sum(axis=0).astype(object)
        out = []
        for c, n in enumerate(count):
            if n:
                out.append((c, -1, 0, n))
                for j, s in enumerate(total[c]):
                    s, limb = int(s), 0
                    while abs(s) >> LIMB:
                        out.append((c, j, limb, s & ((1 << LIMB) - 1)))
                        s, limb = s >> LIMB, limb + 1
                    out.append((c, j, limb, s))
        yield pa.RecordBatch.from_pylist([dict(zip(("c", "j", "limb", "s"), r)) for r in out], schema=pa.schema(
            [("c", pa.int32()), ("j", pa.int32()), ("limb", pa.int32()), ("s", pa.int64())]))

    got = rows.select("v").mapInArrow(run, "c int, j int, limb int, s long").groupBy("c", "j", "limb").agg(
        F.sum("s").alias("s")).collect()  # k x 64 sums, of one limb as a rule
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for r in got:
        if r.j < 0:
            counts[r.c] = r.s
        else:
            sums.setdefault(r.c, [0] * DIM)[r.j] += r.s << LIMB * r.limb
    return counts, sums


def _array(centroids: list[list[int]]) -> np.ndarray:
    big = any(abs(x) > SAFE for c in centroids for x in c)
    return np.array(centroids, dtype=object if big else np.int64).reshape(-1, DIM)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, salt: int = 2) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of every vector after ``rounds`` rounds, and
    the centroids. The driver holds k centroids only."""
    bound_batches(df.sparkSession)
    rows = written(vectors(df), "walsh-vectors")
    centroids = seeds(rows, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        counts, sums = _sums(rows, centroids)
        centroids = _array([[s // counts[c] for s in sums[c]] if c in counts else [int(x) for x in centroids[c]]
                            for c in range(len(centroids))])

    def run(batches):
        for b in batches:
            x = integers(b.column(1))
            to, dist = (search(x, centroids)[:2]) if len(x) else ([], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([int(c) for c in to], pa.int32()),
                 pa.array([int(d) if d <= LONG else None for d in dist], pa.int64())],
                names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long"), centroids


def clustering(df: DataFrame, k: int = 40, rounds: int = 5, salt: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = df.sparkSession
    found, centroids = cluster(df, k, rounds, salt)
    found = written(found, "walsh-assigned")
    # A cluster with a distance that no long holds has no inertia either.
    per = {r.cluster: None if r.lost else int(r.s) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
        F.max(F.col("distance").isNull()).alias("lost")).collect()}  # k rows
    fits = lambda v: v if v is not None and v <= LONG else None
    whole = fits(sum(per.values())) if None not in per.values() else None
    facts = [(c, fits(v), whole, hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest())
             for c, v in per.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, salt: int = 2) -> str:
    """The same clustering in DuckDB SQL, all distances."""
    parts = [f"""v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {DIM}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT id, i, e[i] AS x FROM v, range(1, {DIM + 1}) r(i)),
c0 AS (
  SELECT c, i, e[i] AS m FROM (
    SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), e) - 1 AS c, e FROM v
    QUALIFY c < {k}) s, range(1, {DIM + 1}) r(i))"""]
    for n in range(rounds + 1):
        parts.append(f"""d{n} AS (
  SELECT id, c, sum((x - m) * (x - m))::BIGINT AS d FROM x JOIN c{n} USING (i) GROUP BY id, c),
a{n} AS (SELECT id, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)""")
        if n < rounds:
            parts.append(f"""s{n} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{n} JOIN x USING (id) GROUP BY c, i),
c{n + 1} AS (
  SELECT c, i, CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS m
  FROM c{n} LEFT JOIN s{n} USING (c, i))""")
    return f"""WITH {','.join(parts)},
h AS (SELECT c, sha256(string_agg(m::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} a JOIN v USING (id) JOIN h USING (c)"""

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at most ``radius`` bits apart share a 64-bit value within half
that radius of both. So every distinct fingerprint emits its ball of radius
``radius / 2`` (65 values for radius 2), the values are the shuffle key, and
fingerprints meeting under a value are verified by their bit distance.

Bounded work whatever the data: equal fingerprints collapse to one row first
(a group of a third of all documents is one fingerprint), so the rows under
one value are at most the ball's size. A meeting is recorded as a star
(everything under a value links to the smallest fingerprint there); for
radius 2 two fingerprints under one value are within one bit of it, hence
within two bits of each other, so stars lose no link between components
(:func:`links` verifies each star edge; with an odd radius larger balls are
paired in full, still at most ball-size rows per value).

Defined cases: null text counts as empty; a text without words has
fingerprint zero and links like any other; repeated rows keep one output row
each; null doc_id keeps its row, and never is a component id while the
component has another id; an empty table gives an empty table; extra columns
are ignored.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty, written
from .components import connected_components


def fingerprint_bytes(data: bytes, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of one UTF-8 text (see :func:`fingerprints`)."""
    # bytes.lower() lower-cases A-Z only; bytes.split() splits at 0x20, 0x09-0x0D.
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):  # bounded buffer for very long texts
        block = h[i:i + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (long, the 64 bits as signed) per row.

    A-Z lower-cased, words split at ASCII white space, shingles of ``width``
    words with repeats, XXH64 with ``seed``; a bit is 1 if set in over half
    of the hashes.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(*keep, text_or_empty("text").alias("text"))
    schema = src.drop("text").schema.add("fp", "long")

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).cast(pa.binary()).to_pylist()
            fp = np.fromiter((fingerprint_bytes(t, width, seed) for t in texts),
                             dtype=np.uint64, count=b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns) if i != at] + [pa.array(fp)],
                names=[n for n in b.schema.names if n != "text"] + ["fp"])

    return src.mapInArrow(run, schema)


def ball_masks(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` set bits, as signed longs."""
    out = []
    for k in range(radius + 1):
        for bits in combinations(range(64), k):
            m = sum(1 << b for b in bits)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct ``fps(fp)`` -> verified edges ``(a, b)``, a < b, that connect
    every pair of fingerprints at most ``radius`` bits apart."""
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m) for m in ball_masks(half)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    if radius % 2 == 0:  # a window holds one ball at most
        pairs = variants.select(F.min("fp").over(W.partitionBy("variant")).alias("a"), F.col("fp").alias("b"))
    else:
        other = variants.select("variant", F.col("fp").alias("b"))
        pairs = variants.select("variant", F.col("fp").alias("a")).join(other, "variant").select("a", "b")
    return pairs.where("a < b").distinct().where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _groups(docs: DataFrame, width: int, radius: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, fp)`` per row and ``(fp, component, component_id, keeper)`` per distinct
    fingerprint; keeper: the smallest fingerprint of the component that component_id has."""
    fp = written(fingerprints(docs, width, seed), "fingerprints")
    classes = written(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-classes")
    comp = connected_components(links(classes.select("fp"), radius))
    member = classes.join(comp, classes.fp == comp.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    best = F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "fp")))
    label = member.groupBy("component").agg(best.alias("best"))
    return fp, member.join(label, "component").select(
        "fp", "component", F.col("best.first_id").alias("component_id"), F.col("best.fp").alias("keeper"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lower-case hex digits), ``component_id``
    (smallest doc_id linked through any chain, itself included), one row per input row."""
    fp, groups = _groups(docs, width, radius, seed)
    return fp.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One document of each component, columns as in ``docs``: that with the smallest
    (doc_id, fingerprint), of several such rows the smallest row.

    One doc_id may have different texts; each component keeps its own. Of a
    component whose rows all have a null doc_id one row stays.
    """
    fp, groups = _groups(docs, width, radius, seed)
    groups = written(groups, "fp-groups")
    kept = groups.where("component_id IS NOT NULL").select(
        F.col("component_id").alias("doc_id"), F.col("keeper").alias("fp"), "component").distinct()
    repeated = written(fp.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "fp-repeated")
    out = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    whole = lambda d: fingerprints(d.withColumn("_row", F.struct(*docs.columns)), width, seed, keep=("doc_id", "_row"))
    if repeated.limit(1).count():  # an id alone does not say which row
        several = whole(out.join(repeated, "doc_id", "left_semi")).join(kept, ["doc_id", "fp"])
        several = several.groupBy("component").agg(F.min("_row").alias("_row")).select("_row.*")
        out = out.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(several)
    lone = whole(docs.where("doc_id IS NULL")).join(groups.where("component_id IS NULL"), "fp").groupBy("component").agg(
        F.min("_row").alias("_row"))
    return out.select(*docs.columns).unionByName(lone.select("_row.*"))

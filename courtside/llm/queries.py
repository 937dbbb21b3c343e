"""Registered queries of the training-data operators, whole tables, production parameters."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession

from . import (bpe, packing, quality, quotes, rules, secrets, simhash, spelling, topk, toxicity, vptree, walsh,
               warc)
from .common import crc_mod, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Labels are learned from these rows only (conditions on the labels table).
def quality_train() -> Column:
    return crc_mod("doc_id", 3) != 1


def toxic_train() -> Column:
    return crc_mod("doc_id", 5) != 0


@register("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs, sample_windows=1000))


@register("op2_pivot_topk", sql="""
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5""")
def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(topk.integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return topk.top_products(vectors, vectors.where("vec_id % 50 = 0"), k=5, pivots=32)


@register("op3_warc_archive", sql="""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
w AS (SELECT payload_digest, max(page_id) AS newest FROM p GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM p JOIN w USING (payload_digest)""")
def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), min_revisit_bytes=1000)
    return warc.read_archive(spark, archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.PATTERN, window=2048, end_id=1, keep_ids=False)


@register("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, digests=True)


@register("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.classify(docs, labels, quality_train())
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.scored(docs, toxicity.learn(docs, labels, toxic_train(), sample_rows=10_000))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@register("op8_quotation_linking", sql=quotes.SQL)
def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


@register("op9_vp_tree")
def op9_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(vptree.vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return vptree.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, factor=2.0)


@register("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2, seed=42)


@register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), thin=97, min_symbols=5, min_count=3, ratio=2, levels=64)


@register("op12_walsh_clusters", sql=walsh.sql(k=40, rounds=5, salt=2))
def op12_walsh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walsh.clustering(table(spark, sf_dir, "embeddings"), k=40, rounds=5, salt=2)


@register("op13_quality_rules")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_train(),
                       sample_rows=10_000, min_words=50, max_repeats=50, threshold=0.5)

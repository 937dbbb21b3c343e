"""Corpus pipeline: quality, toxicity, near duplicates, secrets, packing.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows
its predecessor kept; :func:`run` writes each stage's result as a table in the
shared folder and rereads it as the next one's documents. All stages but the
last return the columns of documents.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from courtside.llm import packing, quality, secrets, simhash, toxicity
from courtside.llm.common import table, written
from courtside.llm.queries import quality_train, toxic_train


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), quality_train(), threshold=0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), toxic_train(), threshold=0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, width=3, radius=2, seed=42)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of secrets are replaced; every document stays."""
    return secrets.without_secrets(docs, secrets.learn(docs, sample_windows=1000))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of packed sequences of 2,048 tokens, ids included."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                        window=2048, end_id=1, keep_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

# Learned models, SimHash and token ids have no SQL form: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

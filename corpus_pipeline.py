"""A corpus pipeline: quality filter, exact and near deduplication, secret redaction, packing.

Each stage takes the documents its predecessor kept, with their columns, and all but the last
return documents with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm import exact_dedup, jaccard, packing, quality, secrets
from concord.llm.shared import documents, stored

#: Near duplicates share at least 80 of 100 shingles of five words.
NEAR = jaccard.ShingleJoin(words=5, num=80, den=100)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled rows, predicts good."""
    return quality.keep_good(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id; documents with null ids stay."""
    return NEAR.without_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Compression scores, the forest and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import ann, bpe, exact_dedup, jaccard, packing, quality, secrets, sql, suffix_dedup, token_counts, token_files
from concord.llm.shared import documents, shared_dir


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(documents(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(documents(spark, sf_dir)))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, documents(spark, sf_dir, "labels")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ShingleJoin(words=4, num=85, den=100).components(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", "kind", F.round("score", 6).alias("score"), F.sha2("value", 256).alias("value_sha256")
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), folder)
    return token_files.read_token_files(spark, folder, with_ids=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_nearest_neighbours, op3_bpe_round_trip, op4_quality, op5_ngram_jaccard, op6_exact_dedup, op7_token_counts, op8_secret_scan, op9_token_files, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": sql.SUFFIX_DEDUP,
        "op2_nearest_neighbours": sql.NEAREST_NEIGHBOURS,
        "op5_ngram_jaccard": sql.NGRAM_JACCARD,
        "op6_exact_dedup": sql.EXACT_DEDUP,
    }

"""Exact deduplication by skew-safe combining.

Three combining stages, each of which compares the full text:

1. locally: Spark's map-side aggregation merges equal texts before anything moves. The salt
   is the reading task's number, so that a task sends each text once, however often it has it;
2. salted digest groups: the shuffle key is (digest, salt, text), so that a text that
   all tasks have is merged by ``salts`` tasks and not by one;
3. salt winners: the at most ``salts`` survivors of a text are merged globally.

The text is a grouping key in stages 1 to 3, so equal digests alone never merge rows.
Rows learn their group by an equi-join on the digests of groups with at least two rows;
that join's large side holds no text, and adaptive execution splits a hot digest there.

Defined results: a null text equals the empty text. A null ``doc_id`` is smaller than
every other; if all of a group are null, ``keep_id`` is null and all its rows are kept.
Rows that repeat both ``doc_id`` and text are the same row and are kept or dropped
together; ``drop_copies`` leaves one of them. An empty table gives an empty result. Columns beyond id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.shared import texts

#: Tasks that share the merging of one text, at most.
SALTS = 32


def _keyed(docs: DataFrame, normalise) -> DataFrame:
    rows = docs.withColumn("text", normalise(F.col("text")))
    return rows.select(
        "doc_id",
        "text",
        F.sha2("text", 256).alias("text_sha256"),
        F.xxhash64("text").alias("check"),
        F.octet_length("text").alias("n_bytes"),
    )


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each different text of ``rows`` (as of ``_keyed``): its digests, size and keeper."""
    keys = ["text_sha256", "check", "n_bytes"]
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))  # a sum or maximum is the same however rows are salted
    salted = (
        rows.withColumn("salt", salt)
        .groupBy(*keys, "salt", "text")
        .agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    )
    return (
        salted.groupBy(*keys, "text")
        .agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
        .select(*keys, "keep_id", "group_size")
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=lambda text: text,
    salts: int = SALTS,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    ``normalise`` maps the text column to the column that is compared.
    """
    rows = _keyed(texts(docs, id_col, text_col), normalise)
    keys = ["text_sha256", "check", "n_bytes"]
    copies = combined(rows, salts).where("group_size > 1")
    own: Column = F.coalesce("keep_id", "doc_id")
    return rows.drop("text").join(copies, keys, "left").select(
        "doc_id",
        own.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(own == F.col("doc_id"), own.isNull()).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (``doc_id`` and ``text``).

    Of rows that repeat an id with its text one stays; rows with null ids stay if no other row has their text.
    """
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        known = docs.withColumn("__key", F.coalesce(F.col("text"), F.lit("")))
        single = known.where("doc_id is not null").dropDuplicates(["doc_id", "__key"])
        docs = single.unionByName(known.where("doc_id is null")).drop("__key")
    dropped = exact_groups(docs, **options).where(~F.col("kept")).select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")
    ).distinct()
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return docs.join(
        dropped, (docs["doc_id"].eqNullSafe(dropped["__id"])) & (sha == dropped["__sha"]), "left_anti"
    )

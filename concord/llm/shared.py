"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.sources.scratch import clear, forget, shared_dir, stored

__all__ = ["ROWS", "bounded", "clear", "column_values", "documents", "forget", "release", "shared_dir", "stored", "texts"]

#: Rows and bytes that an operator's Python code handles at once; a longer row is handled alone.
ROWS, BYTES = 512, 4 << 20


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished rounds of an iterative job."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column_values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def bounded(batches, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows and about ``size`` bytes of strings and binaries.

    Spark bounds its batches by the session's settings, which stay as they are.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if n <= rows and batch.nbytes <= size:
            yield batch
            continue
        weights = np.zeros(n, np.int64)
        for column in batch.columns:
            kind = column.type
            if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_list(kind):
                width = 8 if pa.types.is_list(kind) else 1
                weights += width * np.diff(np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4))
            elif pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
                weights += np.diff(np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8))
        ends = np.cumsum(weights)
        at = 0
        while at < n:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to

"""Token ids in files: frequency-ranked, byte-aligned, variable-length.

A file holds blocks of documents in ascending ``doc_id`` order. A block has

* ``ranks``: its distinct ids, most frequent first, as little-endian uint32;
* ``control``: two bits for each token, four tokens a byte, lowest bits first: the length of
  its rank in bytes, less one;
* ``data``: the ranks, least significant byte first, without leading zero bytes.

Frequent ids have small ranks and take one byte. A reader turns the control bytes into lengths
with one table look-up of 256 rows, and lengths into places with a running sum; all of it is
numpy on whole blocks. The blocks are rows of Parquet files that Spark commits, so a lost
executor leaves no torn file and any store that Spark writes will do.

Defined results: null and empty texts have the end id alone; null doc_ids come first; rows that
repeat a ``doc_id`` lie side by side in any order. An empty table gives no rows. Only id and text
are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.bpe import id_lists
from concord.llm.encoders import encoder, vocabulary
from concord.llm.shared import bounded, column_values, texts

VOCABULARY = "word_bpe_49k.json"
BLOCK_TOKENS = 1 << 19
SCHEMA = "part int, block int, n_ids long, doc_ids array<long>, doc_tokens array<long>, ranks binary, control binary, data binary"

#: Lengths of the four tokens of each control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ranks, control, data of a block."""
    distinct, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank_of = np.empty(len(order), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank_of[place]
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) <= extra[:, None]]
    return distinct[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ids(ranks: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    table = np.frombuffer(ranks, "<u4")
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    source = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = source[at].astype(np.int64)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        values[more] |= source[at[more] + k].astype(np.int64) << (8 * k)
    return table[values]


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    end_id: int = 2,
    block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encodes all documents and writes them to ``folder`` in ascending ``doc_id`` order."""
    path = path or vocabulary(VOCABULARY)

    def block(part: int, number: int, names: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(tokens)
        ranks, control, data = encode_ids(ids)
        row = {"part": part, "block": number, "n_ids": len(ids), "doc_ids": names, "doc_tokens": list(map(len, tokens)), "ranks": ranks, "control": control, "data": data}
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("ranks", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches):
        encode, part, number = encoder(path), TaskContext.get().partitionId(), 0
        names, tokens, size = [], [], 0
        for batch in bounded(batches):
            ids, counts = encode(column_values(batch, "text"))
            for name, own in zip(column_values(batch, "doc_id"), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                names.append(name)
                tokens.append(np.append(own, np.int32(end_id)))
                size += len(own) + 1
                if size >= block_tokens:
                    yield block(part, number, names, tokens)
                    number, names, tokens, size = number + 1, [], [], 0
        if names:
            yield block(part, number, names, tokens)

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document in ``folder``.

    Only block sizes go through the running sum: per file first, then within each file.
    """
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    sizes = blocks.select("part", "block", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start")
    )
    inside = before.partitionBy("part").orderBy("block")
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.col("inside")).alias("block_start")
    )

    def run(batches):
        for batch in bounded(batches, 4):
            for row in batch.to_pylist():
                ids = decode_ids(row["ranks"], row["control"], row["data"], row["n_ids"])
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                own = np.split(ids, ends[:-1])
                n = len(own)
                arrays = [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["block"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                ]
                names = ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(id_lists(ids.astype(np.int32), counts))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    decoded = blocks.mapInArrow(run, schema)
    return decoded.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )

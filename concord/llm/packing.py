"""Hierarchical multi-length packing of documents into training sequences.

Within a block of documents:

* routing: every full ``window`` of a document is a sequence of its own; what is left goes to
  the shortest context-size tier that holds it;
* packing: tiers are packed one by one, the longest first. Each left-over of a tier opens a
  window of the tier's size, and the window's gap is filled from shorter left-overs, the longest
  that fits first; if none fits, one is cut and its rest is routed anew. What the longer tiers
  have not used up fills windows of the shortest tier;
* a block's last window, for which no filler is left, is cut at powers of two, which need
  no padding: these are the only sequences of other sizes than the tiers'.
* balancing: the block's sequences are dealt to step groups in turn and back, most costly
  first, so that groups have near-equal token counts and attention costs.

Blocks are bounded by ``block_tokens`` and packed where their documents are read: nothing is
shuffled, and the fillers lost at block ends are a few hundred tokens in a million.

Defined results: null and empty texts have the end id alone. Documents longer than a block are
a block of their own. Rows with null or repeated ids are packed as any other. An empty table
gives an empty result. Only id and text are read from ``docs``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from concord.llm.encoders import encoder, vocabulary
from concord.llm.shared import bounded, column_values, texts

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def powers(n: int) -> list[int]:
    """Powers of two that sum to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length), of documents with these token counts."""
    window = tiers[-1]
    sequences: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for k, n in enumerate(lengths):
        sequences += [[(k, s, window)] for s in range(0, n - n % window, window)]
        if n % window:
            rests.append((n % window, k, n - n % window))
    rests.sort()
    for below, tier in reversed(list(zip((0, *tiers), tiers, strict=False))):
        while rests and rests[-1][0] > below:
            length, k, start = rests.pop()
            sequence, room = [(k, start, length)], tier - length
            while room and rests:
                fit = bisect_right(rests, (room, len(lengths), 0)) - 1
                if fit >= 0:
                    length, k, start = rests.pop(fit)
                    sequence.append((k, start, length))
                    room -= length
                else:  # every rest is longer than the room
                    length, k, start = rests.pop(0)
                    sequence.append((k, start, room))
                    insort(rests, (length - room, k, start + room))
                    room = 0
            sequences += cut(sequence, powers(tier - room)) if room else [sequence]
    return sequences


def cut(pieces: list[tuple[int, int, int]], sizes: list[int]) -> list[list[tuple[int, int, int]]]:
    """The pieces laid end to end, cut into sequences of these sizes."""
    out, pieces = [], list(reversed(pieces))
    for size in sizes:
        own = []
        while size:
            k, start, length = pieces.pop()
            take = min(length, size)
            own.append((k, start, take))
            if take < length:
                pieces.append((k, start + take, length - take))
            size -= take
        out.append(own)
    return out


def step_groups(sequences: list[list[tuple[int, int, int]]], step_tokens: int) -> list[int]:
    """A group for each sequence: about ``step_tokens`` tokens a group, with balanced costs."""
    tokens = [sum(p[2] for p in s) for s in sequences]
    groups = max(1, -(-sum(tokens) // step_tokens))
    order = sorted(range(len(sequences)), key=lambda i: (-tokens[i], -sum(p[2] ** 2 for p in sequences[i]), i))
    out = [0] * len(sequences)
    for place, i in enumerate(order):
        lap, at = divmod(place, groups)
        out[i] = groups - 1 - at if lap % 2 else at
    return out


def pack(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = 1 << 20,
    step_tokens: int = 32 * WINDOW,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece: its place in its document and in its sequence, and its ids if asked for.

    ``sequence_id`` and ``step_group`` are unique over the whole result: their high bits are
    the number of the partition, which a repeated task keeps.
    """
    path = path or vocabulary(VOCABULARY)

    def rows(names: list, tokens: list[np.ndarray], base: int, group_base: int):
        lengths = list(map(len, tokens))
        sequences = pack_block(lengths, tiers)
        groups = step_groups(sequences, step_tokens)
        out: list[list] = [[] for _ in range(10)]
        for number, sequence in enumerate(sequences):
            offset, tier = 0, sum(p[2] for p in sequence)
            for k, start, length in sequence:
                ids = tokens[k][start : start + length]
                values = (names[k], start, length, zlib.crc32(ids.astype("<u4").tobytes()), lengths[k], base + number, offset, tier, group_base + groups[number])
                for column, value in zip(out, values, strict=False):
                    column.append(value)
                if with_ids:
                    out[9].append(ids)
                offset += length
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=False)]
        if with_ids:
            arrays.append(pa.array(out[9], pa.list_(pa.int32())))
        labels = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays(arrays, labels), len(sequences), max(groups, default=0) + 1

    def run(batches):
        encode = encoder(path)
        base = group_base = TaskContext.get().partitionId() << 40
        names, tokens, size = [], [], 0
        for batch in bounded(batches):
            ids, counts = encode(column_values(batch, "text"))
            for name, part in zip(column_values(batch, "doc_id"), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                names.append(name)
                tokens.append(np.append(part, np.int32(end_id)))
                size += len(part) + 1
                if size >= block_tokens:
                    out, n, g = rows(names, tokens, base, group_base)
                    base, group_base, names, tokens, size = base + n, group_base + g, [], [], 0
                    yield out
        if names:
            yield rows(names, tokens, base, group_base)[0]

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return texts(docs, id_col, text_col).mapInArrow(run, schema)

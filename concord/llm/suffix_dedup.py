"""Removal of repeated byte strings, by a range-partitioned sparse suffix array.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a document of
smaller id, or earlier in the same one) is removed; strings are judged on the input.

* Suffixes. Each window of ``length`` bytes is represented by the suffix at its anchor: the
  position of the least hash among the window's grams (``GRAM`` bytes each, leftmost of equals).
  Equal windows have their anchors at equal places, so it is enough to compare suffixes at
  anchors, about one in 39 bytes. (Suffixes at all positions would be 100 times the input in shuffles.)
  A record is the suffix, with the bytes before it that the windows of the anchor reach, at
  most ``2 * length - GRAM`` bytes; its key is the suffix and then those bytes, backwards.
* Range partition. Sampled splitters, which are whole keys, cut the order of suffixes into
  buckets. A gram that many documents have is thus cut at several places.
* Local combining. Of equal records in a batch only the earliest travels; the others' bytes are
  removed at once. A text that a third of the documents share is sent once a batch.
* Sort. A bucket is sorted by multikey quicksort whose characters are words of eight bytes:
  parts equal in a word are sorted by the next, and only records that tie on the gram go on.
* Comparison within a bucket. Records that are equal throughout lose all their bytes but in the
  earliest; where records share the gram and then differ, their windows are compared one by one, by
  hash and then byte by byte.
* Comparison across boundaries. Equal windows can only lie in several buckets if a splitter between them
  begins with the same bytes as their suffixes, up to the windows' end. These windows, and only these,
  go on to a second shuffle by a 128-bit digest of their content, where the earliest of each stays.

Removed ranges return to their documents by an equi-join on the id.

Defined results: null texts are empty. Texts shorter than ``length`` lose nothing. Ids that are
null are smaller than all others. Rows with one id and one text are one document, with one result each;
rows with one id and different texts are ordered by text hash, then text. An empty table gives an empty result. Texts
of any length are read whole. Columns beyond id and text are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.blobs import packed, unpacked
from concord.llm.shared import bounded, column_values, texts
from concord.llm.words import expand, mixed

LENGTH = 100
GRAM = 24
LEAD = 16
#: Bytes handled at once; longer texts are cut, with windows that cross a cut in the former part.
SEGMENT = 1 << 22
#: Bytes of text whose records are combined and sent together.
BATCH_BYTES = 4 << 20
SAMPLE_DOCS, SAMPLE_LEADS = 4000, 8
#: Parts of a sort with no more rows are compared as whole strings.
FEW = 48
NULL_ID = -(1 << 63)
SUB = 40
_MULTIPLIER = 0x9E3779B97F4A7C15


class PrefixHash:
    """64-bit hashes of ranges of bytes, from prefix sums modulo 2**64: they choose anchors, and what is compared by content."""

    def __init__(self, seed: int = 31):
        self.codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.step, self.back = np.uint64(_MULTIPLIER), np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = np.full(size, self.step), np.full(size, self.back)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums with a leading zero."""
        self.powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.down[: len(data)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.powers(len(sums))
        h = (sums[ends] - sums[starts]) * self.up[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _up(n: int) -> int:
    return -(-n // 8) * 8


class Anchors:
    """Records of texts: the anchored suffix in the middle of a row, and where it is from."""

    def __init__(self, length: int = LENGTH):
        if length < GRAM + 16:
            raise ValueError(f"length must be at least {GRAM + 16}")
        self.length, self.grams = length, length - GRAM + 1
        self.left, self.right = _up(self.grams - 1), _up(length)
        self.width = self.left + self.right
        self.hash = PrefixHash()

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None):
        """Anchor, first and last window start of each run of windows with one anchor.

        ``starts``, ``ends``: of texts in ``data``; ``sums``: prefix sums of its hash.
        """
        none = (np.zeros(0, np.int64),) * 3
        long = ends - starts >= self.length
        starts, counts = starts[long], (ends - starts)[long] - self.length + 1
        if not len(starts):
            return none
        n = len(data) - GRAM + 1
        sums = self.hash.prefix(data) if sums is None else sums
        key = mixed((sums[GRAM:] - sums[:n]) * self.hash.up[:n])
        low = np.uint64((1 << 24) - 1)
        key = (key & ~low) | np.arange(n, dtype=np.uint64)
        span = 1
        while span * 2 <= self.grams:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < self.grams:
            rest = self.grams - span
            key = np.minimum(key[:-rest], key[rest:])
        window = expand(starts, counts)
        anchor = (key[window] & low).astype(np.int64)
        heads = np.flatnonzero(np.diff(anchor, prepend=-1))
        tails = np.append(heads[1:], len(anchor)) - 1
        return anchor[heads], window[heads], window[tails]

    def rows(self, data: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The records' bytes, with the anchor in column ``left`` and zeros where a record ends."""
        padded = np.concatenate([np.zeros(self.left, np.uint8), data, np.zeros(self.right, np.uint8)])
        out = np.lib.stride_tricks.sliding_window_view(padded, self.width)[anchor]
        column = np.arange(self.width)
        out[(column < (self.left - (anchor - first))[:, None]) | (column >= (self.left + last + self.length - anchor)[:, None])] = 0
        return out

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """The suffix of each record, and then what is before it, backwards."""
        return np.concatenate([rows[:, self.left :], rows[:, self.left - 1 :: -1]], axis=1)

    def _filled(self, left: np.ndarray, size: np.ndarray) -> np.ndarray:
        column, first = np.arange(self.width, dtype=np.int32), self.left - left.astype(np.int32)
        return (column >= first[:, None]) & (column < (first + size)[:, None])

    def packed(self, rows, left, size, doc, pos) -> bytes:
        """Records without their zeros."""
        fields = packed(left, size, doc, pos, level=3)
        return len(fields).to_bytes(8, "little") + fields + packed(rows[self._filled(left, size)], level=3)

    def unpacked(self, blob: bytes) -> tuple[np.ndarray, ...]:
        end = 8 + int.from_bytes(blob[:8], "little")
        kind = "u1" if self.grams <= 256 else "<u2"
        left, size, doc, pos = unpacked(blob[8:end], (kind, 0), ("<u2", 0), ("<i8", 0), ("<i8", 0))
        rows = np.zeros((len(left), self.width), np.uint8)
        rows[self._filled(left, size)] = unpacked(blob[end:], ("u1", 0))[0]
        return rows, left, size, doc, pos


def segments(raw: bytes, length: int):
    """(offset, bytes) parts of at most ``SEGMENT`` bytes whose windows are the whole's, each once."""
    if len(raw) <= SEGMENT:
        yield 0, raw
        return
    step = SEGMENT - length + 1
    for at in range(0, len(raw) - length + 1, step):
        yield at, raw[at : at + SEGMENT]


def ties(group: np.ndarray) -> np.ndarray:
    """Which places of an ascending group array are in groups of two or more."""
    same = group[1:] == group[:-1]
    return np.append(same, False) | np.append(False, same)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words: three-way partitions by one word; equals go on with the next."""
    n, width = words.shape
    order = np.arange(n)
    open_ = [(0, n, 0)]
    while open_:
        low, high, column = open_.pop()
        if high - low < 2 or column == width:
            continue
        rows = order[low:high]
        if high - low <= FEW:
            rest = np.ascontiguousarray(words[rows, column:]).astype(">u8").view(f"S{8 * (width - column)}").ravel()
            order[low:high] = rows[np.argsort(rest, kind="stable")]
            continue
        key = words[rows, column]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate([rows[less], rows[same], rows[more]])
        open_ += [(low, a, column), (a, b, column + 1), (b, high, column)]
    return order


def _numbered(words: np.ndarray) -> np.ndarray:
    """The place of the first equal row, of sorted rows."""
    head = np.append(True, (words[1:] != words[:-1]).any(axis=1))[: len(words)]
    return np.maximum.accumulate(np.where(head, np.arange(len(words)), 0))


class Bucket:
    """The records of one range of suffixes."""

    def __init__(self, shape: Anchors, rows, left, size, doc, pos):
        self.shape, self.rows, self.left, self.size, self.doc, self.pos = shape, rows, left, size, doc, pos

    def sorted_groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Records in the order of suffixes, equal ones by place; the groups of those with one gram, and of equal ones."""
        shape, words = self.shape, self.rows.view(">u8").astype(np.uint64)
        middle, gram_words = shape.left // 8, GRAM // 8
        ends = self.left.astype(np.uint64) << np.uint64(16) | self.size.astype(np.uint64)
        words = np.concatenate([words[:, middle:], words[:, :middle], ends[:, None]], axis=1)
        order = multikey_quicksort(words)
        words = words[order]
        gram, whole = _numbered(words[:, :gram_words]), _numbered(words)
        by = np.lexsort((self.pos[order], self.doc[order], whole))
        return order[by], gram, whole

    def removed(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Documents, starts and lengths of ranges that repeat something earlier; and the different records, the earliest of each."""
        order, gram, whole = self.sorted_groups()
        head = whole == np.arange(len(whole))
        first = order[whole]
        later = order[(self.doc[order] != self.doc[first]) | (self.pos[order] != self.pos[first])]
        out = [(self.doc[later], self.pos[later], self.size[later].astype(np.int64))]
        heads, grams = order[head], gram[head]
        differ = ties(grams)
        if differ.any():
            out.append(self._windows(heads[differ]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)), heads

    def across(self, heads: np.ndarray, borders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests, documents and starts of the windows of records that may also lie beyond a border (a key), the earliest of each."""
        shape, length = self.shape, self.shape.length
        suffixes = self.rows[heads, shape.left : shape.left + length]
        shared = np.zeros(len(heads), np.int64)
        for border in borders:
            alike = np.flatnonzero((suffixes[:, :GRAM] == border[:GRAM]).all(axis=1))
            differ = suffixes[alike] != border[:length]
            shared[alike] = np.maximum(shared[alike], np.where(differ.any(axis=1), differ.argmax(axis=1), length))
        left, size = self.left[heads].astype(np.int64), self.size[heads].astype(np.int64)
        counts = np.clip(np.minimum(size - length + 1, shared - length + left + 1), 0, None)
        of, inner = np.repeat(heads, counts), expand(np.zeros(len(heads), np.int64), counts)
        if not len(of):
            return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        column = shape.left - self.left[of].astype(np.int64) + inner
        raw = self.rows.tobytes()
        at = (of * shape.width + column).tolist()
        digests = np.frombuffer(b"".join(blake2b(raw[k : k + length], digest_size=16).digest() for k in at), "<u8").reshape(-1, 2)
        return earliest(digests, self.doc[of], self.pos[of] + inner)[0]

    def _windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different records that share a gram: the windows that occur earlier."""
        length, shape = self.shape.length, self.shape
        hasher = shape.hash
        hasher.powers(shape.width + 1)
        data = self.rows[rows]
        sums = np.zeros((len(rows), shape.width + 1), np.uint64)
        np.cumsum(hasher.codes[data] * hasher.down[: shape.width], axis=1, out=sums[:, 1:])
        counts = self.size[rows].astype(np.int64) - length + 1
        of = np.repeat(np.arange(len(rows)), counts)
        inner = expand(np.zeros(len(rows), np.int64), counts)
        column = shape.left - self.left[rows].astype(np.int64)[of] + inner
        h = mixed((sums[of, column + length] - sums[of, column]) * hasher.up[column] + column.astype(np.uint64))
        doc, pos = self.doc[rows][of], self.pos[rows][of] + inner
        order = np.lexsort((pos, doc, h))
        of, inner, column, h, doc, pos = (x[order] for x in (of, inner, column, h, doc, pos))
        head = np.append(True, h[1:] != h[:-1])
        first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
        view = np.lib.stride_tricks.sliding_window_view(data, length, axis=1)
        others = np.flatnonzero(~head)
        apart = np.zeros(len(h), bool)
        for at in range(0, len(others), 1 << 16):
            some = others[at : at + (1 << 16)]
            apart[some] = (view[of[some], column[some]] != view[of[first[some]], column[first[some]]]).any(axis=1)
        seen: dict[tuple[int, bytes], int] = {}
        for k in np.flatnonzero(apart).tolist():  # different windows with one hash: by content
            first[k] = seen.setdefault((int(first[k]), view[of[k], column[k]].tobytes()), k)
        later = np.flatnonzero((doc != doc[first]) | (pos != pos[first]))
        by = np.lexsort((inner[later], of[later]))
        of, inner = of[later][by], inner[later][by]
        new = np.append(True, (of[1:] != of[:-1]) | (inner[1:] != inner[:-1] + 1)) if len(of) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(of)) - 1 if len(heads) else heads
        own = rows[of[heads]]
        return self.doc[own], self.pos[own] + inner[heads], inner[tails] - inner[heads] + length


def earliest(digests: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """(digests, doc, pos) of the earliest of each digest; and (doc, pos) of the others that start elsewhere."""
    order = np.lexsort((pos, doc, digests[:, 1], digests[:, 0]))
    digests, doc, pos = digests[order], doc[order], pos[order]
    first = _numbered(digests)
    head = first == np.arange(len(first))
    later = (doc != doc[first]) | (pos != pos[first])
    return (digests[head], doc[head], pos[head]), (doc[later], pos[later])


def joined_ranges(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching ranges of each document as one."""
    if not len(doc):
        return doc, start, size
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    reach, out = end.copy(), np.ones(len(doc), bool)
    base = np.append(True, doc[1:] != doc[:-1])
    heads = np.flatnonzero(base)
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(doc)).tolist(), strict=True):
        reach[a:b] = np.maximum.accumulate(end[a:b])
    out[1:] = base[1:] | (start[1:] > reach[:-1])
    heads = np.flatnonzero(out)
    tails = np.append(heads[1:], len(doc)) - 1
    return doc[heads], start[heads], reach[tails] - start[heads]


def _records(shape: Anchors, docs: list[int], raws: list[tuple[int, bytes]]):
    """Records of texts; ``raws``: first position and bytes."""
    data = np.frombuffer(b"".join(r for _, r in raws), np.uint8)
    sizes = np.array([len(r) for _, r in raws], np.int64)
    starts = np.cumsum(sizes) - sizes
    sums = shape.hash.prefix(data)
    anchor, first, last = shape.runs(data, starts, starts + sizes, sums)
    text = np.searchsorted(starts, first, "right") - 1
    while len(text) and (bad := sizes[text] == 0).any():  # empty texts share their start with the next
        text[bad] -= 1
    base = np.array([p for p, _ in raws], np.int64)
    return (
        shape.rows(data, anchor, first, last),
        (anchor - first).astype(np.uint8 if shape.grams <= 256 else np.uint16),
        (last - first + shape.length).astype(np.uint16),
        np.array(docs, np.int64)[text],
        first - starts[text] + base[text],
        shape.hash.ranges(sums, first, last + shape.length) + (anchor - first).astype(np.uint64),
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (null as the least), sub, text: the latter tells texts with one id apart."""
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("sub"), "text")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return rows.select("doc_id", (F.dense_rank().over(order) - 1).cast("long").alias("sub"), "text")


def _splitters(rows: DataFrame, shape: Anchors, buckets: int) -> np.ndarray:
    """Keys that cut a bounded sample of suffixes evenly."""
    n = rows.count()
    length = shape.length

    def sampled(batches):
        for batch in bounded(batches):
            for text in column_values(batch, "text"):
                raw = next((raw for _, raw in segments(text.encode("utf-8", "surrogatepass"), length)), b"")
                data = np.frombuffer(raw, np.uint8)
                anchor, first, last = shape.runs(data, np.array([0]), np.array([len(data)]))
                some = np.arange(0, len(anchor), max(1, len(anchor) // SAMPLE_LEADS))[:SAMPLE_LEADS]
                if len(some):
                    keys = shape.keys(shape.rows(data, anchor[some], first[some], last[some]))
                    yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary())], ["key"])

    every = max(1, n // SAMPLE_DOCS)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "sub"), F.lit(every)) == 0).select("text")
    found = sorted(bytes(r.key) for r in sample.mapInArrow(sampled, "key binary").collect())  # about SAMPLE_DOCS * SAMPLE_LEADS keys
    at = [found[len(found) * k // buckets] for k in range(1, buckets)] if found else []
    return np.array(sorted(set(at)), f"S{shape.width}")


def repeated_ranges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length) of ranges to remove, as of ``_keyed`` rows; ``start`` has ``sub`` above bit 40."""
    shape = Anchors(length)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(rows, shape, 4 * partitions)
    buckets = len(splitters) + 1

    def send(held: list) -> pa.RecordBatch:
        row, left, size, doc, pos, h = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pos, doc, h))
        head = np.append(True, h[order][1:] != h[order][:-1])[: len(order)]
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
        later = np.flatnonzero(~head)
        a, b = order[later], first[later]
        equal = (row[a] == row[b]).all(axis=1) & (left[a] == left[b]) & (size[a] == size[b])
        a, b = a[equal], b[equal]
        gone = a[(doc[a] != doc[b]) | (pos[a] != pos[b])]
        same = np.zeros(len(row), bool)
        same[a] = True
        stay = np.flatnonzero(~same)
        lead = np.ascontiguousarray(row[stay, shape.left : shape.left + LEAD]).view(f"S{LEAD}").ravel()
        bucket = np.searchsorted(splitters, shape.keys(row[stay]).view(f"S{shape.width}").ravel(), "right")
        by = np.lexsort((lead, bucket))
        stay, bucket = stay[by], bucket[by]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        at = [k for k in range(buckets) if edges[k + 1] > edges[k]]
        kinds = [0] * len(at)
        blobs = []
        for k in at:
            own = stay[edges[k] : edges[k + 1]]
            blobs.append(shape.packed(row[own], left[own], size[own], doc[own], pos[own]))
        if len(gone):
            d, s, n = joined_ranges(doc[gone], pos[gone], size[gone].astype(np.int64))
            at.append(int(mixed(d[:1].astype(np.uint64))[0]) % buckets)
            kinds.append(1)
            blobs.append(packed(d, s, n))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

    def cut(batches):
        held, size, docs, raws, some = [], 0, [], [], 0
        for batch in bounded(batches):
            for doc, sub, text in zip(*(column_values(batch, c) for c in ("doc_id", "sub", "text")), strict=True):
                for at, raw in segments(text.encode("utf-8", "surrogatepass"), length):
                    docs.append(doc)
                    raws.append(((sub << SUB) + at, raw))
                    some += len(raw)
                    if some >= 1 << 20:
                        held.append(_records(shape, docs, raws))
                        size, docs, raws, some = size + some, [], [], 0
                    if size >= BATCH_BYTES:
                        yield send(held)
                        held, size = [], 0
        if raws:
            held.append(_records(shape, docs, raws))
        if held:
            yield send(held)

    borders = [np.frombuffer(k.ljust(shape.width, b"\0"), np.uint8) for k in splitters.tolist()]
    schema = "bucket int, kind int, blob binary"

    def by_bucket(batches):
        """(bucket, kind, blobs), from rows sorted by bucket and kind; ranges one blob at a time."""
        now, held = None, []
        for batch in bounded(batches, 64):
            for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((bucket, kind) != now or kind == 1):
                    yield *now, held
                    held = []
                now = bucket, kind
                held.append(blob)
        if held:
            yield *now, held

    def compare(batches):
        for bucket, kind, blobs in by_bucket(batches):
            if kind:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])
                continue
            held = Bucket(shape, *(np.concatenate(x) for x in zip(*map(shape.unpacked, blobs), strict=True)))
            ranges, heads = held.removed()
            at, kinds, out = ([bucket], [1], [packed(*joined_ranges(*ranges))]) if len(ranges[0]) else ([], [], [])
            digests, doc, pos = held.across(heads, borders[max(0, bucket - 1) : bucket + 1])
            to = (digests[:, 0] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[k] : edges[k + 1]]
                at.append(k)
                kinds.append(2)
                out.append(packed(digests[own, 0], digests[own, 1], doc[own], pos[own]))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kinds, pa.int32()), pa.array(out, pa.binary())], ["bucket", "kind", "blob"])

    def settle(batches):
        for _, kind, blobs in by_bucket(batches):
            if kind == 1:
                doc, start, size = unpacked(blobs[0], ("<i8", 0), ("<i8", 0), ("<i8", 0))
            else:
                a, b, doc, start = (np.concatenate(x) for x in zip(*(unpacked(blob, ("<u8", 0), ("<u8", 0), ("<i8", 0), ("<i8", 0)) for blob in blobs), strict=True))
                doc, start = earliest(np.stack([a, b], 1), doc, start)[1]
                size = np.full(len(doc), length)
                doc, start, size = joined_ranges(doc, start, size)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "start", "length"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind")

    compared = dealt(rows.mapInArrow(cut, schema)).mapInArrow(compare, schema)
    return dealt(compared).mapInArrow(settle, "doc_id long, start long, length long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, length) and the kept bytes of each row of ``docs``."""
    rows = _keyed(docs, id_col, text_col)
    ranges = repeated_ranges(rows, length).select("doc_id", F.shiftright("start", SUB).alias("sub"), F.struct((F.col("start").bitwiseAND((1 << SUB) - 1)).alias("start"), "length").alias("range"))
    by_doc = ranges.groupBy("doc_id", "sub").agg(F.collect_list("range").alias("ranges"))
    both = rows.join(by_doc, ["doc_id", "sub"], "left").select("doc_id", "text", F.col("ranges.start").alias("starts"), F.col("ranges.length").alias("sizes"))

    def apply(batches):
        for batch in bounded(batches):
            ids, sizes, removed, counts, spans, kept = [], [], [], [], [], []
            for doc, text, starts, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                s = np.array(starts or [], np.int64)
                _, s, n = joined_ranges(np.zeros(len(s), np.int64), s, np.array(lengths or [], np.int64))
                parts, at = [], 0
                for a, b in zip(s.tolist(), (s + n).tolist(), strict=True):
                    parts.append(raw[at:a])
                    at = b
                parts.append(raw[at:])
                ids.append(None if doc == NULL_ID else doc)
                sizes.append(len(raw))
                removed.append(int(n.sum()))
                counts.append(len(s))
                spans.append([{"start": a, "length": b} for a, b in zip(s.tolist(), n.tolist(), strict=True)])
                kept.append(b"".join(parts))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            arrays = [*(pa.array(x, pa.int64()) for x in (ids, sizes, removed, counts)), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, length: long>>, kept binary"
    return both.mapInArrow(apply, schema)

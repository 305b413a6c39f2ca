"""Exact self-join on word-shingle Jaccard similarity, by a token-group matrix.

1. Groups of similar documents. Two sets of similarity t or more, the larger in size class c,
   differ in at most H(c) shingles. Shingles are dealt by hash to H(c) + 1 + x parts, so at
   least 1 + x parts are equal; documents that share a part's exact content (a signature) are
   candidates, and connected candidates are a group. Signatures leave out shingles that are
   frequent in the whole table: a passage that many documents share then puts no one together.
   That is safe, since leaving shingles out never adds differences. A document with more than x
   empty parts (short, or mostly frequent shingles) also files the parts with the frequent
   shingles, and its empty parts if those are still many; if both of a pair do so, the
   equal part is among those. No linked pair is lost.
2. The matrix. A task holds one group, in token groups of ``ROW_DOCS`` documents, each with the
   union of its members' shingles. A query opens a token group only if the union holds enough
   of the query's shingles; opened members are compared exactly. Members known to be connected
   with the query are passed over: that changes no component.
3. Groups over ``GROUP_DOCS`` documents or ``GROUP_SHINGLES`` shingles are first taken apart: a document
   with more shingles of its own than a linked one may lack leaves, and the rest are connected anew by
   the shingles that linked ones must share. Groups that are still over a task are split. Their splits
   are joined each by itself and with the group's least document; documents that are then not
   connected with the group's largest component are queries against every split.

Frequent shingles are known from a table of ``CELLS`` counters over all documents, reduced to one
bit each: that is all that is broadcast. Signatures travel as packed arrays, one per bucket and
batch. Equal sets within a batch send one document's signatures.

Defined results: ``n_shingles`` counts distinct shingles. Null texts and texts without words have
none and link with nothing; texts with fewer words than a shingle have one. Equal sets are linked.
``component_id`` of a document without links is its own id. Rows that repeat a ``doc_id`` have one
result: each different text of an id is a vertex of its own, and vertices of one id are joined afterwards,
so no order of rows matters; ``copies`` does not join them. Null ids take no part (their ``component_id`` is null).
Columns beyond id and text are not read. An empty table gives an empty result.

Signatures are made of 64-bit hashes, which can only make candidates more. Sizes and links are exact: wherever shingles
are counted or compared, words and shingles of one hash are compared by content, and numbered by it.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.blobs import delta, packed, unpacked
from concord.llm.components import components
from concord.llm.shared import bounded, column_values, forget, release, stored, texts
from concord.llm.words import Ranges, mixed

CELL_BITS = 21
CELLS = 1 << CELL_BITS
#: A cell is frequent if its count is over the mean load by this many times the mean's root, and by this count.
FREQUENT_TIMES, FREQUENT_LEAST = 8, 32
#: Bits of a signature that travel; chance agreement makes a candidate more, never a link.
KEY_BITS = 48
ROW_DOCS = 32
GROUP_DOCS, GROUP_SHINGLES = 1024, 1 << 21
BATCH_CHARS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_PLACES = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of texts: runs without ASCII white space, A-Z lower-cased; each text's shingles of ``n`` words."""

    def __init__(self, texts: list[str], n: int):
        raws = [text.encode("utf-8", "surrogatepass") for text in texts]
        data = _LOWER[np.frombuffer(b"\n".join(raws) + b"\n" * 9, np.uint8)]
        change = np.flatnonzero(np.diff(_WHITE[data], prepend=True))
        starts, ends = change[0::2], change[1::2]
        self.n, self.ranges, self._hashes = n, Ranges(data, starts, ends), None
        stops = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        edges = np.concatenate([[0], np.searchsorted(starts, stops)])
        #: First word and number of shingles of each text, and how many words they have.
        self.firsts, words = edges[:-1], np.diff(edges)
        self.sizes = np.minimum(words, n)
        self.counts = np.where(words > 0, np.maximum(words - n + 1, 1), 0)

    def _shingles(self, values: np.ndarray, empty) -> np.ndarray:
        """One row of ``n`` values for each shingle, text after text; short ones end with ``empty``."""
        of = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.repeat(self.firsts - (np.cumsum(self.counts) - self.counts), self.counts) + np.arange(len(of))
        place = np.arange(self.n)
        padded = np.concatenate([values, np.full(self.n, empty, values.dtype)])
        return np.where(place < self.sizes[of][:, None], padded[at[:, None] + place], empty)

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._word_hashes = self.ranges.hashes()
            h = self._shingles(self._word_hashes, np.uint64(0))
            total = h[:, 0] * _PLACES[0]
            for k in range(1, self.n):
                total += h[:, k] * _PLACES[k]
            self._hashes = mixed(total)
        return self._hashes

    def numbers(self) -> tuple[np.ndarray, bool]:
        """One number for each different shingle of all the texts; whether hashes alone would not tell some apart."""
        h = self.hashes()
        rows = self._shingles(self.ranges.numbers(self._word_hashes).astype(np.int32), np.int32(-1))
        order = np.argsort(h, kind="stable")
        sorted_, rows = h[order], rows[order]
        head = np.diff(sorted_, prepend=~sorted_[:1]) != 0
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(head) - 1
        differ = ~head
        differ[1:] &= (rows[1:] != rows[:-1]).any(axis=1)
        if not differ.any():
            return number, False
        seen: dict[tuple, int] = {}
        for k, row in zip(order.tolist(), map(tuple, rows.tolist()), strict=True):
            number[k] = seen.setdefault(row, len(seen))
        return number, True

    def sets(self, shingles: np.ndarray) -> list[np.ndarray]:
        """The sorted different values of each text."""
        return [np.unique(x) for x in np.split(shingles, np.cumsum(self.counts)[:-1])] if len(self.counts) else []


def hashed_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The different shingle hashes of each text."""
    out = []
    for part in _parts(texts):
        words = Words(part, n)
        out += words.sets(words.hashes())
    return out


def exact_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The shingles of each text, as numbers that are equal in all these texts if and only if the shingles are."""
    words = Words(texts, n)
    return words.sets(words.numbers()[0])


def sized_sets(texts: list[str], n: int) -> tuple[list[np.ndarray], list[int]]:
    """``hashed_sets``, and the exact number of different shingles of each text."""
    sets, sizes = [], []
    for part in _parts(texts):
        words = Words(part, n)
        number, hidden = words.numbers()
        own = words.sets(words.hashes())
        sets += own
        sizes += map(len, words.sets(number) if hidden else own)
    return sets, sizes


def _parts(texts: list[str]):
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


@dataclass
class Signatures:
    """Size classes, parts and signatures for a similarity of ``num`` / ``den`` or more."""

    num: int
    den: int

    def __post_init__(self):
        self.bounds = [1]
        self._plans: dict[int, tuple[int, int]] = {}

    def size_class(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(self.bounds[-1] * self.den // self.num + 1)
        return bisect_right(self.bounds, size) - 1

    def plan(self, c: int) -> tuple[int, int]:
        """Parts, and how many of them may be empty, for pairs whose larger set is of class ``c``."""
        if c not in self._plans:
            while len(self.bounds) < c + 2:
                self.bounds.append(self.bounds[-1] * self.den // self.num + 1)
            differ = (self.den - self.num) * 2 * (self.bounds[c + 1] - 1) // (self.den + self.num)
            least, spare = self.bounds[max(0, c - 1)], 0
            while differ and spare < differ + 8:
                mean = (differ + 1 + spare) * (1 - 1 / (differ + 1 + spare)) ** least
                tail, term = 1.0, math.exp(-mean)
                for k in range(spare + 1):
                    tail -= term
                    term *= mean / (k + 1)
                if tail < 1e-3:
                    break
                spare += 1
            self._plans[c] = differ + 1 + spare, spare
        return self._plans[c]

    def __call__(self, sets: list[np.ndarray], frequent: np.ndarray, exact: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of non-empty sets, and the index of the set that each is of. ``exact``: sizes, if hashes hide some."""
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        if not len(sets):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        rare = ~frequent[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        own = np.array([self.size_class(n) for n in exact or sizes.tolist()])
        found, found_of = [], []
        for step in (0, 1):
            classes = own + step
            plans = np.array([self.plan(c) for c in classes.tolist()])
            parts, spare = plans[:, 0], plans[:, 1]
            many = self._filed(tokens[rare], of[rare], classes, parts, 1, found, found_of) > spare
            if many.any():
                again = many[of]
                still = self._filed(tokens[again], of[again], classes, parts, 2, found, found_of) > spare
                for k in np.flatnonzero(many & still).tolist():
                    held = np.bincount(self._part(tokens[of == k], parts[k]), minlength=parts[k])
                    empty = np.flatnonzero(held == 0)
                    found.append(self._key(np.zeros(len(empty), np.uint64), classes[k], empty, 3))
                    found_of.append(np.full(len(empty), k))
        return np.concatenate(found), np.concatenate(found_of)

    @staticmethod
    def _part(tokens: np.ndarray, parts) -> np.ndarray:
        return ((mixed(tokens) >> np.uint64(32)) * np.asarray(parts).astype(np.uint64) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def _key(content: np.ndarray, classes, part, scheme: int) -> np.ndarray:
        place = np.asarray(classes).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.asarray(part).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        return mixed(content + mixed(place + np.uint64(scheme)))

    def _filed(self, tokens, of, classes, parts, scheme, found, found_of) -> np.ndarray:
        """Files the signatures of non-empty parts; the number of empty parts of each set."""
        first = np.cumsum(parts) - parts
        place = first[of] + self._part(tokens, parts[of])
        order = np.argsort(place, kind="stable")
        place, content = place[order], mixed(tokens[order] ^ np.uint64(0x5851F42D4C957F2D))
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        if len(heads):
            owner, sums = of[order][heads], np.add.reduceat(content, heads)
            found.append(self._key(sums, classes[owner], place[heads] - first[owner], scheme))
            found_of.append(owner)
        else:
            owner = np.zeros(0, np.int64)
        return parts - np.bincount(owner, minlength=len(parts))


class Forest:
    """Union-find over 0 .. n-1; roots are the least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """How many items of sorted ``a`` are in sorted ``b``."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


class TokenGroups:
    """Documents in token groups, with each token group's union."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        order = sorted((k for k in range(len(sets)) if len(sets[k])), key=lambda k: (int(sets[k][0]), len(sets[k]), k))
        self.order = np.array(order, np.int64)
        self.groups = [self.order[at : at + ROW_DOCS] for at in range(0, len(order), ROW_DOCS)]
        self.unions = [np.unique(np.concatenate([sets[k] for k in g])) for g in self.groups]
        sizes = [[len(sets[k]) for k in g] for g in self.groups]
        self.least, self.most = np.array([min(x) for x in sizes], np.int64), np.array([max(x) for x in sizes], np.int64)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = sorted((len(a), len(b)))
        if self.den * small < self.num * large:
            return False
        both = shared_count(a, b) if len(a) <= len(b) else shared_count(b, a)
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def link(self, query: np.ndarray, open_: Callable[[], np.ndarray], linked: Callable[[int], None]) -> None:
        """Compares a query's set with the members for which ``open_()`` (by member) holds; calls ``linked(member)``."""
        n, held = len(query), open_()
        if not len(self.order):
            return
        some = np.logical_or.reduceat(held[self.order], np.arange(0, len(self.order), ROW_DOCS))
        some &= (self.den * self.most >= self.num * n) & (self.num * self.least <= self.den * n)
        for g in np.flatnonzero(some).tolist():
            members = self.groups[g]
            if len(members) > 1 and self.den * shared_count(query, self.unions[g]) < self.num * n:
                continue
            for k in members.tolist():
                if held[k] and self.similar(query, self.sets[k]):
                    linked(k)
                    held = open_()


class Labels:
    """Components of a bounded number of items, as an array of their least members."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def union(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)


def connect(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The least member of each set's component, by the links among all sets."""
    labels, first = Labels(len(sets)), {}
    copy_of = np.arange(len(sets))
    for k, own in enumerate(sets):
        if len(own):
            copy_of[k] = first.setdefault(own.tobytes(), k)
    alone = np.array(sorted(first.values()), np.int64)
    groups = TokenGroups([sets[k] for k in alone.tolist()], num, den)
    for place, k in enumerate(alone.tolist()):
        groups.link(sets[k], lambda place=place, k=k: (np.arange(len(alone)) > place) & (labels.of[alone] != labels.of[k]), lambda m, k=k: labels.union(int(alone[m]), k))
    return labels.of[copy_of]


@dataclass(frozen=True)
class ShingleJoin:
    words: int
    num: int
    den: int

    def _frequent(self, rows: DataFrame) -> tuple[np.ndarray, DataFrame, bool]:
        """One bit for each counter: whether its shingles are frequent; (doc_id, n_shingles); whether two shingles of a text have one hash."""
        words, slices = self.words, 16
        shift = np.uint64(64 - CELL_BITS)

        def count(batches):
            cells = np.zeros(CELLS, np.uint32)
            for batch in bounded(batches):
                texts = column_values(batch, "text")
                sets, exact = sized_sets(texts, words)
                for part in _by_size(sets):
                    cells += np.bincount((part >> shift).astype(np.int64), minlength=CELLS).astype(np.uint32)
                none = pa.nulls(len(sets))
                hidden = pa.array([n - len(s) for n, s in zip(exact, sets, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.int64()), hidden, none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "n_shingles", "hidden", "slice", "cells"])
            for k, part in enumerate(np.split(cells, slices)):
                if part.any():
                    none = pa.array([None], pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, pa.array([k], pa.int32()), pa.array([packed(part)], pa.binary())], ["doc_id", "n_shingles", "hidden", "slice", "cells"])

        counted = stored(rows.mapInArrow(count, "doc_id long, n_shingles long, hidden long, slice int, cells binary"), "shingle-counts")
        info = counted.where("slice is null").select("doc_id", "n_shingles")
        said = counted.where("slice is null").agg(F.sum("n_shingles").alias("n"), F.sum("hidden").alias("hidden")).first()
        mean = (said.n or 0) / CELLS
        least = int(mean + FREQUENT_TIMES * math.sqrt(mean) + FREQUENT_LEAST)

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in bounded(batches, 16):
                for k, blob in zip(column_values(batch, "slice"), column_values(batch, "cells"), strict=True):
                    part = unpacked(blob, ("<u4", 0))[0]
                    sums[k] = sums[k] + part if k in sums else part.astype(np.uint64)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(v >= least).tobytes() for v in sums.values()], pa.binary())], ["slice", "bits"])

        cells = counted.where("slice is not null").select("slice", "cells").repartition(slices, "slice")
        frequent = np.zeros(CELLS, bool)
        for row in cells.mapInArrow(add, "slice int, bits binary").collect():  # CELLS / 8 bytes
            at = row.slice * (CELLS // slices)
            frequent[at : at + CELLS // slices] = np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)
        return frequent, info, bool(said.hidden)

    def _candidates(self, rows: DataFrame, frequent: np.ndarray, hidden: bool) -> DataFrame:
        """(a, b): edges that connect the documents that share a signature.

        A batch sends each signature once, with its least document, and a forest of its own documents; a bucket's signatures are
        merged one bucket at a time.
        """
        spark = rows.sparkSession
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets, words, num, den = 4 * partitions, self.words, self.num, self.den
        bits = spark.sparkContext.broadcast(np.packbits(frequent).tobytes())
        schema = "bucket int, kind int, blob binary"

        def sent(at: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([kind] * len(at), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

        def dealt(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            """Edges by the bucket of their first document."""
            bucket = (mixed(a.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            at = [k for k in range(buckets) if edges[k + 1] > edges[k]]
            return sent(at, 1, [packed(a[own], b[own]) for own in (order[edges[k] : edges[k + 1]] for k in at)])

        def out(pending):
            docs = np.concatenate([p[0] for p in pending])
            first, links, keep = {}, [], []
            sets, exact = [s for p in pending for s in p[1]], [n for p in pending for n in p[2]]
            for k, s in enumerate(sets):
                if len(s):
                    other = first.setdefault((s.tobytes(), exact[k]), k)
                    if other == k:
                        keep.append(k)
                    else:
                        links.append((k, other))
            frequent = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
            keys, of = Signatures(num, den)([sets[k] for k in keep], frequent, [exact[k] for k in keep])
            owner = np.array(keep, np.int64)[of] if keep else of
            keys >>= np.uint64(64 - KEY_BITS)
            order = np.lexsort((docs[owner], keys))
            keys, owner = keys[order], owner[order]
            head = np.diff(keys, prepend=~keys[:1]) != 0
            same = owner[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))] if len(keys) else owner
            pairs = np.concatenate([np.stack([owner, same], 1)[~head], np.array(links, np.int64).reshape(-1, 2)])
            if len(pairs):
                yield dealt(*_forest(docs[pairs[:, 0]], docs[pairs[:, 1]]))
            keys, owner = keys[head], docs[owner[head]]
            bucket = ((keys >> np.uint64(KEY_BITS - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            at = [k for k in range(buckets) if edges[k + 1] > edges[k]]
            yield sent(at, 0, [packed(delta(keys[edges[k] : edges[k + 1]]), owner[edges[k] : edges[k + 1]]) for k in at])

        def file(batches):
            pending, size = [], 0
            for batch in bounded(batches):
                texts = column_values(batch, "text")
                sets = hashed_sets(texts, words)
                sizes = sized_sets(texts, words)[1] if hidden else list(map(len, sets))
                docs = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
                pending.append((docs, sets, sizes))
                size += sum(map(len, sets))
                if size >= 1 << 21:
                    yield from out(pending)
                    pending, size = [], 0
            if pending:
                yield from out(pending)

        def by_bucket(batches):
            """(kind, blobs) of each bucket, from rows sorted by bucket and kind."""
            now, held = None, []
            for batch in bounded(batches):
                for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (bucket, kind) != now and held:
                        yield now[1], held
                        held = []
                    now = bucket, kind
                    held.append(blob)
            if held:
                yield now[1], held

        def gather(batches):
            for kind, blobs in by_bucket(batches):
                if kind:
                    yield sent([0] * len(blobs), 1, blobs).set_column(0, "bucket", pa.array([_bucket_of(b, buckets) for b in blobs], pa.int32()))
                    continue
                found = [unpacked(blob, ("<u8", 0), ("<i8", 0)) for blob in blobs]
                keys, docs = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in found]), np.concatenate([d for _, d in found])
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                head = np.diff(keys, prepend=~keys[:1]) != 0
                least = docs[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]
                other = least != docs
                if other.any():
                    yield dealt(*_forest(docs[other], least[other]))

        def merge(batches):
            """All roots of a document meet: it keeps the least, and so do the others."""
            for _, blobs in by_bucket(batches):
                pairs = np.unique(np.concatenate([np.stack(unpacked(blob, ("<i8", 0), ("<i8", 0)), 1) for blob in blobs]), axis=0)
                head = np.append(True, pairs[1:, 0] != pairs[:-1, 0])
                least = pairs[np.maximum.accumulate(np.where(head, np.arange(len(pairs)), 0)), 1]
                more = np.unique(np.stack([pairs[:, 1], least], 1)[~head], axis=0)
                out = np.concatenate([pairs[head], more])
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

        def shuffled(rows: DataFrame) -> DataFrame:
            return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind")

        filed = shuffled(rows.mapInArrow(file, schema))
        return shuffled(filed.mapInArrow(gather, schema)).mapInArrow(merge, "a long, b long").distinct()

    def _grouped(self, rows: DataFrame, handle, schema: str) -> DataFrame:
        """Calls ``handle`` with the rows, as lists, of each (comp, part); a group is all that is held."""
        names = rows.columns

        def run(batches):
            now, held = None, []
            for batch in bounded(batches, 256):
                columns = [c.to_pylist() for c in batch.columns]
                for row in zip(*columns, strict=True):
                    if row[:2] != now:
                        if held:
                            yield handle(dict(zip(names, map(list, zip(*held, strict=True)), strict=True)))
                        now, held = row[:2], []
                    held.append(row)
            if held:
                yield handle(dict(zip(names, map(list, zip(*held, strict=True)), strict=True)))

        return rows.repartition("comp", "part").sortWithinPartitions("comp", "part", "doc_id").mapInArrow(run, schema)

    def _members(self, groups: DataFrame, info: DataFrame) -> DataFrame:
        """(doc_id, comp, n_shingles, parts) of all members of groups; ``parts``: the tasks that a group is for."""
        members = groups.select(F.col("a").alias("doc_id"), F.col("b").alias("comp"))
        members = members.unionByName(members.select(F.col("comp").alias("doc_id"), "comp").distinct()).join(info, "doc_id")
        sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_DOCS), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES)).cast("int").alias("parts"))
        members = _salted_join(members, sizes.where("parts > 1"), "comp")
        return stored(members.select("doc_id", "comp", "n_shingles", F.coalesce("parts", F.lit(1)).alias("parts")), "groups")

    def _apart(self, large: DataFrame) -> DataFrame:
        """(a, b), as of ``components``: the members of large groups, connected by shingles that linked ones must share.

        Of n shingles, at most d = n - ceil(n * num / den) are not in a linked document. One with more that no other of its group
        holds links with nothing. Of the rest, in order of the number of documents that hold a shingle, the first one that two linked
        documents share is among the first d + 1 of both.
        """
        words, num, den = self.words, self.num, self.den
        most = F.col("n_shingles") - F.ceil(F.col("n_shingles") * num / den)

        def hold(batches):
            for batch in bounded(batches):
                docs, comps = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1))
                sets = hashed_sets(column_values(batch, "text"), words)
                keys = [np.unique(mixed(s + own)) for s, own in zip(sets, mixed(comps.astype(np.uint64)), strict=True)]  # chance agreement leaves one more in
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(docs, list(map(len, keys)))), pa.array(np.concatenate(keys).view(np.int64))], ["doc_id", "key"])

        def held(docs: DataFrame) -> DataFrame:
            return docs.select("doc_id", "comp", "text").mapInArrow(hold, "doc_id long, key long")

        once = held(large).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
        once = once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("once"))
        left = stored(large.join(once.hint("merge"), "doc_id", "left").where(F.coalesce("once", F.lit(0)) <= most).select("doc_id", "comp", "text", most.alias("most")), "left")
        keys = stored(held(left), "keys")
        counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "key"))
        placed = keys.join(counts.hint("merge"), "key").withColumn("place", first).join(left.select("doc_id", "most").hint("merge"), "doc_id")
        shared = stored(placed.where("n > 1 and place <= most + 1").select("doc_id", "key"), "shared")
        least = shared.groupBy("key").agg(F.min("doc_id").alias("b"))
        found = components(shared.withColumnRenamed("doc_id", "a").join(least.hint("merge"), "key").select("a", "b"))
        for table in (left, keys, shared):
            forget(table)
        return found

    def _verified(self, rows: DataFrame, groups: DataFrame, info: DataFrame) -> DataFrame:
        """(doc_id, component_id) of all members of candidate groups. ``groups``: (a, b) as of ``components``; ids are unique."""
        words, num, den = self.words, self.num, self.den
        members = self._members(groups, info)
        found, held = rows.join(members.hint("merge"), "doc_id"), None  # one plan at every size
        if not members.where("parts > 1").isEmpty():
            held = stored(found, "members")
            release(rows.sparkSession)
            large = held.where("parts > 1")
            again = self._members(self._apart(large), info)
            found = held.where("parts = 1").unionByName(large.select("doc_id", "text").join(again.hint("merge"), "doc_id"))
        own_part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")

        def join_group(group: dict) -> pa.RecordBatch:
            ids, roots = group["doc_id"], connect(exact_sets(group["text"], words), num, den)
            least: dict[int, int] = {}
            for i, r in zip(ids, roots.tolist(), strict=True):
                least[r] = min(i, least.get(r, i))
            split = group["parts"][0] > 1
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([least[r] for r in roots.tolist()], pa.int64()), pa.array(group["parts"], pa.int32()), pa.array(group["comp"], pa.int64()), pa.array(group["text"] if split else [None] * len(ids), pa.string())], ["doc_id", "root", "parts", "comp", "text"])

        where = F.when(F.col("doc_id") == F.col("comp"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own_part))
        split = found.select("comp", F.explode(where).alias("part"), "doc_id", "text", "parts")
        joined = stored(self._grouped(split, join_group, "doc_id long, root long, parts int, comp long, text string"), "joined")
        if held is not None:
            forget(held)
        release(rows.sparkSession)
        done = joined.where("parts = 1").select("doc_id", F.col("root").alias("component_id"))
        if joined.where("parts > 1").isEmpty():
            return done

        # groups over one task: labels so far, then what is outside each group's largest component against all
        large = joined.where("parts > 1")
        links = components(large.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
        label = F.coalesce("b", "doc_id")
        labelled = large.select("doc_id", "comp", "parts").distinct().join(links.withColumnRenamed("a", "doc_id"), "doc_id", "left").select("doc_id", "comp", "parts", label.alias("label"))
        labelled = stored(labelled, "labelled")
        counts = labelled.groupBy("comp", "label").count()
        largest = counts.groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
        own_text = large.where((F.col("doc_id") != F.col("comp"))).select("doc_id", "text").unionByName(large.where("doc_id = comp").groupBy("doc_id").agg(F.first("text").alias("text")))
        sides = _salted_join(labelled, largest, "comp").join(own_text, "doc_id")
        query = F.when(F.col("label") != F.col("top"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array().cast("array<int>"))
        both = sides.select("comp", own_part.alias("part"), "doc_id", "text", "label", F.lit(0).alias("asks")).unionByName(
            sides.select("comp", F.explode(query).alias("part"), "doc_id", "text", "label", F.lit(1).alias("asks"))
        )

        def ask_group(group: dict) -> pa.RecordBatch:
            sets = exact_sets(group["text"], words)
            names, of = np.unique(np.array(group["label"], np.int64), return_inverse=True)
            labels = Labels(len(names))
            held = np.flatnonzero(np.array(group["asks"]) == 0)
            groups = TokenGroups([sets[k] for k in held.tolist()], num, den)
            for q, asks in enumerate(group["asks"]):
                if asks and len(sets[q]):
                    groups.link(sets[q], lambda q=q: labels.of[of[held]] != labels.of[of[q]], lambda m, q=q: labels.union(int(of[held[m]]), int(of[q])))
            linked = np.flatnonzero(labels.of != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array(names[linked], pa.int64()), pa.array(names[labels.of[linked]], pa.int64())], ["a", "b"])

        more = components(self._grouped(both, ask_group, "a long, b long"))
        rest = labelled.join(more.withColumnRenamed("a", "label"), "label", "left").select("doc_id", F.coalesce("b", "label").alias("component_id"))
        return done.unionByName(rest)

    def _linked(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(doc_id, component_id) of the rows whose component is another's, and (doc_id, n_shingles); ids are unique and not null."""
        frequent, info, hidden = self._frequent(rows)
        groups = components(self._candidates(rows, frequent, hidden))
        release(rows.sparkSession)  # signatures come to almost the size of the texts, which are dealt next
        return self._verified(rows, groups, info).where("doc_id <> component_id"), info

    def components(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_shingles, component_id of each row of ``docs``."""
        rows = texts(docs, id_col, text_col)
        named = rows.where("doc_id is not null")
        if not _repeated(named):
            linked, info = self._linked(named)
            info = info.unionByName(self._frequent(rows.where("doc_id is null"))[1]) if _any_null(rows) else info
        else:
            vertices = _vertices(named)
            linked, _ = self._linked(vertices.select(F.col("vertex").alias("doc_id"), "text"))
            roots = linked.join(vertices.select(F.col("vertex").alias("component_id"), F.col("doc_id").alias("b")), "component_id")
            edges = vertices.select(F.col("vertex").alias("v"), F.col("doc_id").alias("a")).join(roots.select(F.col("doc_id").alias("v"), "b"), "v").select("a", "b")
            linked = components(edges).select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
            info = self._frequent(rows)[1]
        return info.join(linked, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

    def without_copies(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` (``doc_id``, ``text`` and more) without those linked with one of smaller id.

        Where an id has several texts, each is judged by itself, in the order of ids and then of texts.
        """
        rows = texts(docs)
        named = rows.where("doc_id is not null")
        if not _repeated(named):
            dropped = self._linked(named)[0].select(F.col("doc_id").alias("__dropped"))
            return docs.join(dropped, docs["doc_id"] == dropped["__dropped"], "left_anti")
        vertices = _vertices(named)
        linked = self._linked(vertices.select(F.col("vertex").alias("doc_id"), "text"))[0].select(F.col("doc_id").alias("vertex"))
        dropped = vertices.join(linked, "vertex", "left_semi").select(F.col("doc_id").alias("__dropped"), F.col("text").alias("__text"))
        same = (docs["doc_id"] == dropped["__dropped"]) & (F.coalesce(docs["text"], F.lit("")) == dropped["__text"])
        return docs.join(dropped, same, "left_anti")


def _by_size(sets: list[np.ndarray]):
    """The non-empty sets, small ones together."""
    small = [s for s in sets if 0 < len(s) <= CELLS // 8]
    if small:
        yield np.concatenate(small)
    yield from (s for s in sets if len(s) > CELLS // 8)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document of the edges but the least of its component, and that."""
    names, at = np.unique(np.stack([a, b], 1), return_inverse=True)
    forest = Forest(len(names))
    for x, y in at.reshape(-1, 2).tolist():
        forest.union(x, y)
    roots = np.array([forest.root(k) for k in range(len(names))], np.int64)
    linked = np.flatnonzero(roots != np.arange(len(names)))
    return names[linked], names[roots[linked]]


def _bucket_of(blob: bytes, buckets: int) -> int:
    return int(mixed(unpacked(blob, ("<i8", 0), ("<i8", 0))[0][:1].astype(np.uint64))[0] % np.uint64(buckets))


#: Tasks that share one key of a large side.
SALTS = 64


def _salted_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``few``, which has a row for each of its keys: that is repeated for each salt."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    repeated = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(repeated, [key, "salt"], "left").drop("salt")


def _repeated(named: DataFrame) -> bool:
    """Whether a doc_id occurs twice."""
    return not named.groupBy("doc_id").count().where("count > 1").isEmpty()


def _any_null(rows: DataFrame) -> bool:
    return not rows.where("doc_id is null").isEmpty()


def _vertices(named: DataFrame) -> DataFrame:
    """(vertex, doc_id, text) of each different row, numbered in the order of ids and then of texts."""
    ordered = named.distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.select(F.monotonically_increasing_id().alias("vertex"), "doc_id", "text"), "vertices")

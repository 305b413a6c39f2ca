"""Byte-pair encoding by speculation, and decoding.

Distinct pre-tokens are proposed by greedy longest match against the vocabulary. A proposal
equals the merge order's result exactly if each of its tokens re-encodes to itself and each
adjacent pair of tokens is compatible, that is, if merging the two tokens' bytes gives back
the two tokens. All different pairs of a batch are tested together with numpy; only the
pre-tokens with an incompatible pair are merged exactly.

Decoding looks up the bytes of all ids of a batch in one table.

Texts of all scripts go this way: the tokenizers library is asked once for its classes of
characters and for no text.

Defined results: null and empty texts have no ids and decode to the empty text. Texts of any
length are read whole. A special token's string in a text becomes that token's id, as the
tokenizers library has it. Rows with equal ids or texts are encoded alike; an empty table
gives an empty result; columns of ``docs`` other than id and text are not read.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from concord.llm.encoders import BYTE_LEVEL, vocabulary
from concord.llm.shared import bounded, column_values, texts
from concord.llm.words import WordIds, expand, regex_classes, split_spaced

VOCABULARY = "byte_bpe_50k.json"
NEVER = np.int64(1) << 40
#: Longer pre-tokens are merged with a heap.
SHORT = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = {}, 256
    for byte in range(256):
        if byte in plain:
            out[chr(byte)] = byte
        else:
            out[chr(free)], free = byte, free + 1
    return out


class MergeRules:
    """A byte-level BPE vocabulary; inside, tokens are numbered by the order of their merges, single bytes first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if said["pre_tokenizer"] != BYTE_LEVEL or said["normalizer"] is not None:
            raise ValueError(f"{path} is no byte-level vocabulary without a normalizer")
        letters, vocab = byte_letters(), said["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        by_text = {letter: byte for letter, byte in letters.items()}
        left, right = list(range(256)), list(range(256))
        for a, b in merges:
            left.append(by_text[a])
            right.append(by_text[b])
            by_text[a + b] = len(left) - 1
        if len(by_text) != len(left):
            raise ValueError(f"{path}: two merges make one token")
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        n = len(left)
        self.public = np.zeros(n, np.int32)
        self.bytes: list[bytes] = [b""] * n
        for text, k in by_text.items():
            self.public[k], self.bytes[k] = vocab[text], bytes(letters[c] for c in text)
        keys = self.left[256:] * n + self.right[256:]
        order = np.argsort(keys)
        self.size, self.pair_keys, self.pair_made = n, keys[order], order.astype(np.int64) + 256
        self.made = dict(zip(zip(left[256:], right[256:], strict=True), range(256, n), strict=True))
        self.number = {b: k for k, b in enumerate(self.bytes)}
        lengths: dict[bytes, set[int]] = {}
        for b in self.bytes:
            lengths.setdefault(b[:2], set()).add(len(b))
        self.lengths = {b: sorted(x, reverse=True) for b, x in lengths.items()}
        self.sound = np.ones(n, bool)
        self.sound[256:] = self.compatible(self.left[256:], self.right[256:], np.arange(256, n))
        self.specials = {t["content"]: t["id"] for t in said["added_tokens"]}
        top = max([int(self.public.max()), *self.specials.values()]) + 1
        pieces = [b""] * top
        for k in range(n):
            pieces[self.public[k]] = self.bytes[k]
        for text, k in self.specials.items():
            pieces[k] = text.encode()
        self.piece_lengths = np.array([len(x) for x in pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, NEVER where it doesn't."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_made[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of each pair leaves the border between its tokens.

        Walks back from the last merges on both sides of the border: at each step, a merge
        across the border that comes before the merges already undone would have been made.
        ``own``: the merge of the pair itself, which doesn't count.
        """
        ok, open_ = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        bound = np.full(len(a), NEVER) if own is None else own.astype(np.int64).copy()
        while len(open_):
            across = self.merge_of(a, b) < bound
            ok[open_[across]] = False
            go = ~across
            open_, a, b, bound = open_[go], a[go], b[go], bound[go]
            undo_left = (a > b) & (a >= 256)
            undo_right = ~undo_left & (b >= 256)
            rest_left = ~undo_left & ~undo_right & (a >= 256)
            go = undo_left | undo_right | rest_left
            undo_left |= rest_left
            bound = np.where(undo_left, a, np.where(undo_right, b + 1, bound))
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_right, self.left[b], b)
            open_, a, b, bound = open_[go], a[go], b[go], bound[go]
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        if (k := self.number.get(word)) is not None:
            return [k]
        out, at, n, number = [], 0, len(word), self.number
        while at < n:
            for length in self.lengths.get(word[at : at + 2], (1,)):
                if (k := number.get(word[at : at + length])) is not None and at + length <= n:
                    out.append(k)
                    at += length
                    break
            else:
                out.append(word[at])
                at += 1
        return out

    def merged_together(self, words: list[bytes]) -> list[np.ndarray]:
        """The exact merges of many short words, one merge of each word in each round."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        tokens, owner = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.repeat(np.arange(len(words)), counts)
        done_tokens, done_owner = [], []
        while len(tokens):
            pair = np.full(len(tokens), NEVER)
            inner = owner[1:] == owner[:-1]
            pair[:-1][inner] = self.merge_of(tokens[:-1][inner], tokens[1:][inner])
            firsts = np.flatnonzero(np.append(True, ~inner))
            least = np.minimum.reduceat(pair, firsts)
            least_of = np.repeat(least, np.diff(np.append(firsts, len(tokens))))
            ended = least_of == NEVER
            done_tokens.append(tokens[ended])
            done_owner.append(owner[ended])
            chosen = (pair == least_of) & ~ended
            at = np.flatnonzero(chosen)
            if len(at):  # of overlapping pairs, as in a row of equal bytes, every second
                run = np.cumsum(np.append(0, np.diff(at) != 1))
                place = np.arange(len(at)) - np.searchsorted(run, run)
                at = at[place % 2 == 0]
                tokens = tokens.copy()
                tokens[at] = pair[at]
            keep = ~ended
            keep[at + 1] = False
            tokens, owner = tokens[keep], owner[keep]
        tokens, owner = np.concatenate(done_tokens), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.split(tokens[order], np.searchsorted(owner[order], np.arange(1, len(words))))

    def merged(self, word: bytes) -> list[int]:
        """The exact merges of one long word, with a heap."""
        tokens: list[int | None] = list(word)
        after, before = [*range(1, len(word) + 1)], [*range(-1, len(word) - 1)]
        heap = [(k, i) for i in range(len(word) - 1) if (k := self.made.get((word[i], word[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] is None or j >= len(tokens) or self.made.get((tokens[i], tokens[j])) != k:
                continue
            tokens[i], tokens[j], after[i] = k, None, after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
                if (m := self.made.get((k, tokens[after[i]]))) is not None:
                    heapq.heappush(heap, (m, i))
            if (p := before[i]) >= 0 and (m := self.made.get((tokens[p], k))) is not None:
                heapq.heappush(heap, (m, p))
        return [t for t in tokens if t is not None]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Public ids of distinct pre-tokens, one after another, and their counts."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = [self.propose(w) for w in raw]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        tokens = np.fromiter((k for x in found for k in x), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(found)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, of = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)
        failing = np.unique(np.concatenate([owner[inner[~fits[of]]], owner[~self.sound[tokens]]]))
        self.failed = len(failing)
        short = [k for k in failing.tolist() if len(raw[k]) <= SHORT]
        for k, x in zip(short, self.merged_together([raw[k] for k in short]) if short else [], strict=True):
            found[k] = x
        for k in failing.tolist():
            if len(raw[k]) > SHORT:
                found[k] = self.merged(raw[k])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        tokens = np.fromiter((k for x in found for k in x), np.int64, int(counts.sum()))
        return self.public[tokens], counts

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts' ids, and how many each text has."""
        lengths = self.piece_lengths[ids]
        data = self.piece_bytes[expand(self.piece_starts[ids], lengths)] if len(ids) else np.zeros(0, np.uint8)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return data, np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        data, sizes = self.decode_bytes(ids, counts)
        ends = np.cumsum(sizes).tolist()
        raw = data.tobytes()
        return [raw[e - n : e].decode("utf-8", "replace") for e, n in zip(ends, sizes.tolist(), strict=True)]


@lru_cache(maxsize=2)
def rules(path: str) -> MergeRules:
    return MergeRules(path)


@lru_cache(maxsize=2)
def speculative(path: str) -> WordIds:
    merge = rules(path)
    return WordIds(split_spaced, merge, regex_classes(), specials=merge.specials)


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of each row of ``docs``."""
    path = path or vocabulary(VOCABULARY)

    def run(batches):
        for batch in bounded(batches):
            ids, counts = speculative(path)(column_values(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(ids, counts)], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encoded`` (doc_id, ids) and ``decoded``, the text of the ids."""
    path = path or vocabulary(VOCABULARY)

    def run(batches):
        for batch in bounded(batches):
            lists = batch.column(1)
            counts = np.diff(np.asarray(lists.offsets))
            decoded = rules(path).decode(np.asarray(lists.flatten()), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")

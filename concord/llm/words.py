"""Vectorised pre-tokenisation and a bounded table of distinct pre-tokens.

Texts are split with numpy: one class for each character, boundaries from class changes. The
classes of all code points are asked once of the tokenizers library's own regular expressions.
Each distinct pre-token is encoded once per Python worker, and its ids are kept in a
table of fixed maximal size; when the table is full it starts anew, so memory is
bounded and no text is treated differently.

Pre-tokens are looked up by hash, and each hit is compared with the stored pre-token's content;
what only has another's hash is looked up by its content.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

CODES = 0x110000
SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
#: Characters that are handled at once. Longer texts are cut before white space.
CHARS = 1 << 20


@lru_cache(maxsize=1)
def regex_classes() -> np.ndarray:
    """The class of each code point, as the library's expressions \\s, \\p{L} and \\p{N} have it."""
    from tokenizers import Regex, pre_tokenizers

    table = np.full(CODES, OTHER, np.uint8)
    split = [(kind, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)) for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"))]
    for low in [*range(0, 0xD800, 512), *range(0xE000, 0x40000, 512), 0xE0000]:  # other planes hold no letters, numbers or spaces
        every = "".join(map(chr, range(low, low + 512)))
        for kind, pieces in split:
            for piece, _ in pieces.pre_tokenize_str(every):
                table[np.frombuffer(piece.encode("utf-32-le"), np.uint32)] = kind
    return table


@lru_cache(maxsize=1)
def space_classes() -> np.ndarray:
    """Only white space and the rest: categories Z, U+0009 to U+000D, U+0085."""
    table = np.full(CODES, OTHER, np.uint8)
    table[[9, 10, 11, 12, 13, 0x85, *(c for c in range(0x10000) if unicodedata.category(chr(c))[0] == "Z")]] = SPACE
    return table


@lru_cache(maxsize=1)
def lower_codes() -> tuple[np.ndarray, np.ndarray]:
    """The lower-case code of each code point, and where composition or more than one code point may come in.

    The latter are marks, characters that compose with one before, or are not in composed form, unassigned
    ones, and those whose lower-case form has two code points.
    """
    lower, care = np.arange(CODES, dtype=np.uint32), np.ones(CODES, bool)
    for code in [*range(0xD800), *range(0xE000, 0x32000)]:
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Lo", "Co") and not 0x1100 <= code < 0x1200 and unicodedata.is_normalized("NFC", char) and not unicodedata.combining(char):
            care[code] = False
            continue
        low = char.lower()
        lower[code] = ord(low) if len(low) == 1 else code
        care[code] = kind[0] == "M" or kind == "Cn" or len(low) > 1 or 0x1100 <= code < 0x1200 or unicodedata.combining(char) != 0 or not unicodedata.is_normalized("NFC", char)
    return lower, care


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def expand(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices offsets[i], offsets[i]+1, ... of counts[i] items each, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offsets - (ends - counts), counts) + np.arange(total)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


class Ranges:
    """Ranges of a byte array, none empty, as words of eight bytes with zeros behind."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """``data`` has eight bytes behind the last range."""
        self.sizes = ends - starts
        self.counts = (self.sizes + 7) >> 3
        self.firsts = np.cumsum(self.counts) - self.counts
        self.place = np.arange(int(self.counts.sum())) - np.repeat(self.firsts, self.counts)
        at = np.repeat(starts, self.counts) + 8 * self.place
        left = np.repeat(ends, self.counts) - at
        self.words = np.lib.stride_tricks.sliding_window_view(data, 8)[at].view("<u8").ravel() if len(at) else np.zeros(0, np.uint64)
        short = np.flatnonzero(left < 8)
        self.words[short] &= _MASKS[left[short]]

    def hashes(self) -> np.ndarray:
        """Equal ranges have equal hashes; different ones seldom do, and callers compare."""
        if not len(self.sizes):
            return np.zeros(0, np.uint64)
        each = mixed(self.words + self.place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return mixed(np.add.reduceat(each, self.firsts) + self.sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def equal(self, other: np.ndarray) -> np.ndarray:
        """Whether each range has the content of the range ``other[i]`` of the same array."""
        same = self.sizes == self.sizes[other]
        alike = np.flatnonzero(same)
        return self._compared(same, alike, self.words, self.firsts[other])

    def equal_to(self, words: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each range has the content of the words from ``firsts[i]`` on, of ``sizes[i]`` bytes."""
        same = self.sizes == sizes
        return self._compared(same, np.flatnonzero(same), words, firsts)

    def _compared(self, same, alike, words, firsts) -> np.ndarray:
        if len(alike):
            counts = self.counts[alike]
            hit = self.words[expand(self.firsts[alike], counts)] == words[expand(firsts[alike], counts)]
            same[alike] = np.logical_and.reduceat(hit, np.cumsum(counts) - counts)
        return same

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """One number for each different content."""
        if not len(self.sizes):
            return np.zeros(0, np.int64)
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        number = number.reshape(-1)
        same = self.equal(first[number])
        seen: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            own = self.words[self.firsts[k] : self.firsts[k] + self.counts[k]].tobytes() + int(self.sizes[k]).to_bytes(8, "little")
            number[k] = seen.setdefault(own, len(first) + len(seen))
        return number


class HashTable:
    """Open addressing over 64-bit keys with int32 values; keys and look-ups are arrays."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where absent."""
        h = np.maximum(h, np.uint64(1))
        at = (h & self.mask).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == h, self.values[at], np.int32(-1))
        left = np.flatnonzero((held != h) & (held != 0))
        while len(left):
            at_left = (at[left] + 1) & int(self.mask)
            at[left] = at_left
            held = self.keys[at_left]
            hit = held == h[left]
            out[left[hit]] = self.values[at_left[hit]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct, absent keys."""
        h = np.maximum(h, np.uint64(1))
        if (self.n + len(h)) * 2 > len(self.keys):
            old = self.keys != 0
            keys, kept = self.keys[old], self.values[old]
            self.clear(int((self.n + len(h)) * 4 - 1).bit_length())
            self.add(keys, kept)
        self.n += len(h)
        at = (h & self.mask).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[at[left]] == 0
            claim = left[free]
            self.keys[at[claim]] = h[claim]
            won = np.zeros(len(h), bool)
            won[claim] = self.keys[at[claim]] == h[claim]
            self.values[at[claim[won[claim]]]] = values[claim[won[claim]]]
            left = left[~won[left]]
            at[left] = (at[left] + 1) & int(self.mask)


def _contractions(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of apostrophes at token starts: those of 's 't 'm 'd 're 've 'll, and their lengths."""
    n = len(codes)
    one = codes[np.minimum(at + 1, n - 1)]
    two = codes[np.minimum(at + 2, n - 1)]
    short = (at + 1 < n) & np.isin(one, [ord(c) for c in "stmd"])
    long = (at + 2 < n) & (
        ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    )
    keep = short | long
    return at[keep], np.where(short, 2, 3)[keep]


def _neighbours(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.empty_like(kinds), np.empty_like(kinds)
    before[0] = after[-1] = BREAK
    before[1:], after[:-1] = kinds[:-1], kinds[1:]
    return before, after


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)


def split_spaced(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens that carry one leading space: contractions, letters, numbers, others, white space."""
    before, after = _neighbours(kinds)
    spaced = np.zeros(len(codes), bool)
    spaced[1:] = (codes[:-1] == 32) & (kinds[:-1] == SPACE)
    start = np.where(kinds == SPACE, (before != SPACE) | ((after != SPACE) & (after != BREAK)), (kinds != before) & ~spaced)
    stop = kinds == BREAK
    start &= ~stop
    return _cut(codes, kinds, start, stop)


def split_plain(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens without white space: contractions, letters, single numbers, others."""
    before, _ = _neighbours(kinds)
    stop = (kinds == BREAK) | (kinds == SPACE)
    start = ((kinds != before) | (kinds == NUMBER)) & ~stop
    return _cut(codes, kinds, start, stop)


def _cut(codes, kinds, start, stop) -> tuple[np.ndarray, np.ndarray]:
    quotes = np.flatnonzero(start & (codes == 39))
    if len(quotes):
        at, lengths = _contractions(codes, quotes)
        inside = kinds[np.minimum(at + 1, len(kinds) - 1)] == LETTER
        at, lengths = at[inside], lengths[inside]
        start[at + 1] = False
        after = at + lengths
        after = after[after < len(codes)]
        start[after[~stop[after]]] = True
    edges = np.flatnonzero(start | stop)
    ends = _ends(edges, len(codes))
    own = start[edges]
    return edges[own], ends[own]


def split_words(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs without white space."""
    before, _ = _neighbours(kinds)
    stop = (kinds == BREAK) | (kinds == SPACE)
    before_stop = (before == BREAK) | (before == SPACE)
    edges = np.flatnonzero((stop != before_stop) | stop)
    ends = _ends(edges, len(codes))
    own = ~stop[edges]
    return edges[own], ends[own]


class WordIds:
    """Flat values (token ids) of texts, each distinct pre-token computed once.

    ``compute(words)`` gives (flat values, counts) for a list of distinct pre-tokens. ``specials``: strings that
    are cut out of texts first, with their ids. ``normalise``: composes and lower-cases a text; it is called for texts
    with characters for which the table of lower-case codes is not enough.
    """

    def __init__(self, split, compute, classes: np.ndarray, normalise: Callable[[str], str] | None = None, specials: dict[str, int] | None = None, max_words: int = 1_200_000, chars: int = CHARS):
        self.split, self.compute, self.classes, self.normalise, self.specials = split, compute, classes, normalise, specials or {}
        self.max_words, self.chars = max_words, chars
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.white = re.compile("(?<=[^" + (white := "".join(map(chr, np.flatnonzero(classes == SPACE)))) + "])(?=[" + white + "])")
        self._empty()

    def _empty(self) -> None:
        self.table, self.rows, self.twins = HashTable(), 0, {}
        self.offsets, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.places, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0
        self.content, self.held = np.zeros(4096, np.uint64), 0

    @staticmethod
    def _grown(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, len(array) * 3 // 2) - len(array), array.dtype)])

    def _store(self, words: list[str], ranges: Ranges, which: np.ndarray) -> np.ndarray:
        """Rows of new words, which are the ranges ``which``."""
        flat, counts = self.compute(words)
        first, n = self.rows, self.rows + len(words)
        self.offsets, self.counts, self.places, self.sizes = (self._grown(x, n) for x in (self.offsets, self.counts, self.places, self.sizes))
        self.flat = self._grown(self.flat, self.used + len(flat))
        self.offsets[first:n] = self.used + np.cumsum(counts) - counts
        self.counts[first:n] = counts
        self.flat[self.used : self.used + len(flat)] = flat
        lanes = ranges.counts[which]
        content = ranges.words[expand(ranges.firsts[which], lanes)]
        self.content = self._grown(self.content, self.held + len(content))
        self.content[self.held : self.held + len(content)] = content
        self.places[first:n] = self.held + np.cumsum(lanes) - lanes
        self.sizes[first:n] = ranges.sizes[which]
        self.rows, self.used, self.held = n, self.used + len(flat), self.held + len(content)
        return np.arange(first, n, dtype=np.int32)

    def _codes(self, texts: list[str]) -> np.ndarray:
        """The code points of the texts, a zero after each; eight more at the end."""
        joined = "\0".join(texts) + "\0" * 9
        return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)

    def rows_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all pre-tokens, and the number of pre-tokens in each text."""
        if self.rows > self.max_words:
            self._empty()
        codes = self._codes(texts)
        if self.normalise:
            lower, care = lower_codes()
            if care[codes].any():
                texts = [self.normalise(t) if not t.isascii() and care[self._codes([t])].any() else t for t in texts]
                codes = self._codes(texts)
            codes = lower[codes]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.cumsum(lengths + 1) - lengths - 1
        kinds = self.classes[codes]
        kinds[firsts + lengths], kinds[-9:] = BREAK, BREAK
        starts, ends = self.split(codes, kinds)
        if codes.max() < 0x80:
            raw, at = codes.astype(np.uint8), None
        else:
            raw = np.frombuffer(codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            widths = (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            at = np.cumsum(widths + 1) - widths - 1
        byte_starts, byte_ends = (starts, ends) if at is None else (at[starts], at[ends])
        ranges = Ranges(raw, byte_starts, byte_ends)
        h = np.maximum(ranges.hashes(), np.uint64(1))
        rows = self.table.find(h)

        def words(which: np.ndarray) -> list[str]:
            return [raw[s:e].tobytes().decode("utf-8", "surrogatepass") for s, e in zip(byte_starts[which].tolist(), byte_ends[which].tolist(), strict=True)]

        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            if self.rows and self.rows + len(new) > self.max_words:
                self._empty()
                return self.rows_of(texts)
            at = missing[first]
            self.table.add(new, self._store(words(at), ranges, at))
            rows[missing] = self.table.find(h[missing])
        other = np.flatnonzero(~ranges.equal_to(self.content, self.places[rows], self.sizes[rows]))
        if len(other):  # another word's hash
            said = words(other)
            unseen = {w: k for w, k in zip(said, other.tolist(), strict=True) if w not in self.twins}
            if unseen:
                made = self._store(list(unseen), ranges, np.array(list(unseen.values())))
                self.twins |= zip(unseen, made.tolist(), strict=True)
            rows[other] = [self.twins[w] for w in said]
        return rows, np.diff(np.searchsorted(starts, np.append(firsts, len(codes))))

    def _part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows, words = self.rows_of(texts)
        counts = self.counts[rows]
        flat = self.flat[expand(self.offsets[rows], counts)] if len(rows) else np.zeros(0, np.int32)
        sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return flat, np.diff(sums[np.concatenate([[0], np.cumsum(words)])])

    def _cuts(self, text: str):
        """The text in parts that are split alike apart and together: white space never goes on after another character."""
        at = 0
        while len(text) - at > self.chars:
            found = self.white.search(text, at + self.chars)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts one after another, and how many each text has."""
        flats, counts, owners, part, owner, size = [np.zeros(0, np.int32)], [], [], [], [], 0
        specials = self.specials

        def done():
            nonlocal part, owner, size
            if part:
                flat, n = self._part(part)
                flats.append(flat)
                counts.append(n)
                owners.append(owner)
                part, owner, size = [], [], 0

        for k, text in enumerate(texts):
            for piece in self.special.split(text) if self.special and any(s in text for s in specials) else (text,):
                if piece in specials:
                    done()
                    flats.append(np.array([specials[piece]], np.int32))
                    counts.append(np.ones(1, np.int64))
                    owners.append([k])
                    continue
                for cut in self._cuts(piece) if piece else ():
                    part.append(cut)
                    owner.append(k)
                    size += len(cut) + 1
                    if size >= self.chars:
                        done()
        done()
        total = np.zeros(len(texts), np.int64)
        if owners:
            np.add.at(total, np.concatenate([np.array(o, np.int64) for o in owners]), np.concatenate(counts))
        return np.concatenate(flats), total

"""Token ids of whole texts, equal to those of the tokenizers library."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from concord.llm.words import WordIds, regex_classes, split_plain, split_spaced

#: What a tokenizer file must say for the vectorised splitters to apply (fixed values).
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def vocabulary(name: str) -> str:
    """The path of one of the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def flattened(encodings) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in encodings]
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum())), counts


class Library:
    """The tokenizers library on lists of texts, without special tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flattened(self.tokenizer.encode_batch(texts, add_special_tokens=False))


def prepared(path: str) -> tuple[Library, object]:
    """The library for pre-tokens that are normalised already, and its normalizer."""
    from tokenizers import normalizers

    library = Library(path)
    normalizer = library.tokenizer.normalizer
    if normalizer is not None:
        library.tokenizer.normalizer = normalizers.Sequence([])
    return library, normalizer


@lru_cache(maxsize=4)
def encoder(path: str) -> WordIds | Library:
    """Of this Python worker; a file with rules unknown here is left to the library as a whole."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    before, normalizer = said["pre_tokenizer"], said["normalizer"]
    specials = {t["content"]: t["id"] for t in said["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in said["added_tokens"]):
        return Library(path)
    if before == BYTE_LEVEL and normalizer is None:
        return WordIds(split_spaced, Library(path), regex_classes(), specials=specials)
    if normalizer == WORD_NORMALIZER and before["pretokenizers"][0]["pattern"]["Regex"] == WORD_PATTERN:
        library, own = prepared(path)
        return WordIds(split_plain, library, regex_classes(), own.normalize_str, specials)
    return Library(path)

"""Token counts under a unigram model, with the forward scores of a trie.

A pre-token is U+2581 and a maximal run of characters that are not white space. Its best
segmentation has the greatest sum of piece scores and, of those, the fewest pieces. The
distinct pre-tokens of a batch are inserted in a trie. A node's forward scores (best score and
piece count of its prefix) are computed when the node is made, from its ancestors' scores, so a
prefix that pre-tokens share is scored once; a pre-token's count is that of its terminal node.
A trie of ``MOST_NODES`` nodes starts anew. A worker keeps terminal counts in a table of bounded
size, so that a pre-token is inserted once per worker.

Pieces are those of a public vocabulary file; tokenizers are not trained here. That file gives
merge ranks and no probabilities, so the score of the piece with rank r is Zipf's
log-probability, -log(r + 2.7) up to a constant. A character without a piece costs one piece
for each of its UTF-8 bytes, at a score below every piece's.

Defined results: null and empty texts, and texts of white space, have no words and no tokens.
Whole texts of any length are read; equal texts have equal counts; an empty table gives an
empty result; only id and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from concord.llm.encoders import vocabulary
from concord.llm.shared import bounded, column_values, texts
from concord.llm.words import WordIds, space_classes, split_words

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
ZIPF_SHIFT = 2.7
BYTE_PENALTY = 10.0
MOST_NODES = 500_000


def piece_scores(path: str) -> dict[str, float]:
    """Normal pieces and their scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [k for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    shares = 1 / (np.arange(len(pieces)) + ZIPF_SHIFT)
    scores = np.log(shares / shares.sum())
    return {model.id_to_piece(k): float(s) for k, s in zip(pieces, scores, strict=True)}


class Trie:
    """Forward scores of the prefixes of pre-tokens; piece counts of their best segmentations."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.byte = min(scores.values()) - BYTE_PENALTY
        endings: dict[str, set[int]] = {}
        for piece in scores:
            endings.setdefault(piece[-1], set()).add(len(piece))
        #: Lengths of the pieces that end with a character.
        self.endings = {c: sorted(n) for c, n in endings.items()}
        self._empty()

    def _empty(self) -> None:
        #: For each node: its children by character, and the best score and piece count of its prefix.
        self.children: list[dict[str, int]] = [{}]
        self.best, self.pieces = [0.0], [0]

    def _node(self, word: str, path: list[int], last: str) -> int:
        """A child of the last node of ``path`` for the character ``last``, which ends the prefix of ``word``."""
        end, scores = len(path), self.scores
        n = len(last.encode("utf-8", "surrogatepass"))
        top, fewest = self.best[path[-1]] + self.byte * n, self.pieces[path[-1]] + n
        for length in self.endings.get(last, ()):
            if length > end:
                break
            own = scores.get(word[end - length : end])
            if own is not None:
                before = path[end - length]
                own += self.best[before]
                if own > top or own == top and self.pieces[before] + 1 < fewest:
                    top, fewest = own, self.pieces[before] + 1
        self.children[path[-1]][last] = node = len(self.best)
        self.children.append({})
        self.best.append(top)
        self.pieces.append(fewest)
        return node

    def insert(self, word: str) -> int:
        """The terminal node of the word."""
        path = [0]
        for last in word:
            node = self.children[path[-1]].get(last)
            path.append(self._node(word, path, last) if node is None else node)
        return path[-1]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The piece count of each word, one value a word."""
        counts = np.zeros(len(words), np.int32)
        for k, word in enumerate(words):
            if len(self.best) > MOST_NODES:
                self._empty()
            counts[k] = self.pieces[self.insert(MARK + word)]
        return counts, np.ones(len(words), np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> WordIds:
    return WordIds(split_words, Trie(piece_scores(path)), space_classes())


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each row of ``docs``."""
    path = path or vocabulary(VOCABULARY)

    def run(batches):
        for batch in bounded(batches):
            values, words = counter(path)(column_values(batch, "text"))
            sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            tokens = np.diff(sums[np.concatenate([[0], np.cumsum(words)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long")

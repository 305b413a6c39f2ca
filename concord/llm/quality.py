"""Quality classifier by compression.

One zstandard dictionary is built from good labelled texts and one from bad ones. A text is
compressed whole, in chunks of ``CHUNK`` bytes so that a long text cannot outgrow the
dictionaries, once with each dictionary. The difference of the two compressed sizes over the
text's size, together with the good-dictionary ratio (which tells texts that merely repeat
themselves), goes through a logistic calibration fitted on labelled rows that the dictionaries
have not seen. Scores depend on the text alone.

Fitting takes a bounded sample: at most ``rows`` labelled rows of each class for the
dictionaries and as many for the calibration, the ones with the least hash of ``doc_id``,
none longer than ``max_bytes``. Scoring reads every row and every byte.

Defined results: null and empty texts get the calibrated score of a zero difference. Null ids
are never held out and never labelled. Of several labels of one document the larger counts.
Without rows of both classes every score is the smoothed share of good rows. An empty table
gives an empty result. Only id and text are read from ``docs``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.shared import bounded, column_values, texts

CHUNK = 512
LEVEL = 3
DICTIONARY_BYTES = 110 * 1024
ROWS = 1500
MAX_BYTES = 1 << 16


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]

    def compressors(self):
        out = []
        for raw in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """1, normalised size difference, good-dictionary ratio of each text."""
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1
        if not self.good:
            return out
        good, bad = (c.compress for c in self.compressors())
        for k, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            if not raw:
                out[k, 2] = 0.5
                continue
            by_good = by_bad = 0
            for at in range(0, len(raw), CHUNK):
                part = raw[at : at + CHUNK]
                by_good += len(good(part))
                by_bad += len(bad(part))
            out[k, 1:] = (by_bad - by_good) / len(raw), by_good / len(raw)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -30, 30)))


def dictionary(samples: list[str]) -> bytes:
    """Trained on the samples' chunks; of too few samples, their text itself."""
    parts = [raw[at : at + 4096] for raw in (s.encode("utf-8", "surrogatepass") for s in samples) for at in range(0, len(raw), 4096)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, max_bytes: int = MAX_BYTES) -> CompressionModel:
    """A model from the labelled rows that are not held out."""
    own = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .withColumn("part", (F.floor(fold(F.col("doc_id")) / 3) % 2).cast("int"))
    )
    body = texts(docs).where(F.octet_length("text") <= max_bytes)
    chosen = None
    for kind in (0, 1):
        for part in (0, 1):
            few = own.where((F.col("label") == kind) & (F.col("part") == part)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
            chosen = few if chosen is None else chosen.unionByName(few)
    # at most 4 * rows ids
    found = body.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "part", "text").collect()
    found = sorted({(r.doc_id, r.label, r.part, r.text) for r in found})
    by = {(kind, part): [r[3] for r in found if r[1:3] == (kind, part)] for kind in (0, 1) for part in (0, 1)}
    n = [len(by[k, 0]) + len(by[k, 1]) for k in (0, 1)]
    if not by[0, 0] or not by[1, 0] or not (by[0, 1] and by[1, 1]):
        return CompressionModel(b"", b"", (float(np.log((n[1] + 1) / (n[0] + 1))), 0.0, 0.0))
    model = CompressionModel(dictionary(by[1, 0]), dictionary(by[0, 0]), (0.0, 0.0, 0.0))
    x = np.concatenate([model.features(by[0, 1]), model.features(by[1, 1])])
    y = np.repeat([0.0, 1.0], [len(by[0, 1]), len(by[1, 1])])
    # classes were sampled apart: weigh the bias back to their true shares
    w = logistic(x, y)
    shares = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    w[0] += np.log(shares[1] / shares[0]) - np.log(len(by[1, 1]) / len(by[0, 1]))
    return CompressionModel(model.good, model.bad, tuple(map(float, w)))


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches):
        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(column_values(batch, "text")))], ["doc_id", "score"])

    scored = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in bounded(batches):
            scores = model.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def crc_of(doc_id: int) -> int:
    """What ``fold`` gives, for tests."""
    return zlib.crc32(str(doc_id).encode())

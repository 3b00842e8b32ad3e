"""Quality by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from texts labelled good, one from texts labelled bad. A text is compressed in
blocks with each of them, so that the dictionary serves a long text from start to end and memory stays
bounded. The difference of the compressed sizes, normalised by the bytes of the text, becomes a probability by a logistic calibration on labelled texts that built neither dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm import common

BLOCK_BYTES = 1024
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[at:at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]


def build_dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the texts themselves where they are too few to train one."""
    samples = [b for t in texts for b in blocks(t)]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of a text with one dictionary."""

    def __init__(self, dictionary: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(dictionary) >= 8:
            known = zstandard.ZstdCompressionDict(dictionary)
            known.precompute_compress(level=LEVEL)
            options["dict_data"] = known
        self.compressor = zstandard.ZstdCompressor(**options)

    def of(self, parts: list[bytes]) -> int:
        compress = self.compressor.compress
        return sum(len(compress(p)) for p in parts)


@dataclass
class CompressionModel:
    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    offset: float = 0.0
    _sizes: list = field(default_factory=list, repr=False)

    def __getstate__(self):  # compressors are made where they are used
        return {"good": self.good, "bad": self.bad, "slope": self.slope, "offset": self.offset, "_sizes": []}

    def difference(self, text: str | None) -> float:
        """Bytes that the good dictionary saves against the bad one, for each byte; 0 for an empty text."""
        if not self._sizes:
            self._sizes = [Sizes(self.good), Sizes(self.bad)]
        parts = blocks(text)
        good, bad = (s.of(parts) for s in self._sizes)
        return (bad - good) / sum(map(len, parts)) if parts else 0.0

    def score(self, text: str | None) -> float:
        z = np.clip(self.slope * self.difference(text) + self.offset, -30.0, 30.0)
        return float(1.0 / (1.0 + np.exp(-z)))


def calibrate(x: np.ndarray, y: np.ndarray, share: float, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps, lightly regularised), classes weighted to ``share``."""
    if not len(y) or y.min() == y.max():
        return 0.0, float(np.log(share / (1 - share)))
    scale = x.std() or 1.0
    a = np.c_[x / scale, np.ones(len(x))]
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w = np.zeros(2)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + np.array([1e-2, 0.0]) * w
        hess = (a.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ a + np.diag([1e-2, 1e-9])
        w -= np.clip(np.linalg.solve(hess, grad), -2.0, 2.0)
    return float(w[0] / scale), float(w[1])


def fit_sample(sample: list[tuple[str, int]], share: float) -> CompressionModel:
    """Two thirds of the (text, good) pairs build the dictionaries, the others calibrate.

    Without labels of both kinds every text scores ``share``.
    """
    share = min(max(share, 0.01), 0.99)
    by = {y: [t for t, label in sample if label == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return CompressionModel(offset=float(np.log(share / (1 - share))))
    split = {y: (texts[: max(1, 2 * len(texts) // 3)], texts[2 * len(texts) // 3:] or texts) for y, texts in by.items()}
    model = CompressionModel(good=build_dictionary(split[1][0]), bad=build_dictionary(split[0][0]))
    held = [(t, y) for y in (0, 1) for t in split[y][1]]
    x = np.array([model.difference(t) for t, _ in held])
    model.slope, model.offset = calibrate(x, np.array([y for _, y in held], float), share)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = common.SAMPLE_ROWS,
        max_bytes: int = common.SAMPLE_BYTES) -> CompressionModel:
    """Learn from a bounded sample of ``docs(doc_id, text)``, fold 0 of crc32 modulo 5 left out."""
    learn = ~common.is_held_out(5, 0)
    share = labels.filter(learn & F.col("quality").isNotNull()).agg(F.avg("quality")).first()[0]
    return fit_sample(common.labelled_sample(docs, labels, "quality", rows, max_bytes, learn),
                      0.5 if share is None else float(share))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; repeated rows score alike.

    Null and empty texts have no difference and get the calibrated score of zero. Rows without an id are
    scored and never learned from. No shuffle of texts.
    """
    model = fit(docs, labels)
    worker = lambda: lambda rows, texts: pa.RecordBatch.from_arrays(
        [rows.column("doc_id"), pa.array([model.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])
    scored = common.map_texts(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", worker)
    return scored.select("doc_id", common.is_held_out(5, 0).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``. All columns pass unchanged, whatever their names; null
    and empty texts go by the calibrated score of zero, repeated rows go together, an empty table stays empty."""
    model = fit(docs, labels)
    worker = lambda: lambda rows, texts: rows.filter(pa.array([model.score(t) >= threshold for t in texts], pa.bool_()))
    return common.map_texts(docs, docs.schema, worker)

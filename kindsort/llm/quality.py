"""Quality by compression.

One zstandard dictionary is built from good and one from bad labelled text.  A text is
compressed piece by piece with each; the dictionary whose text it resembles makes it
smaller.  The normalised difference of the two sizes, with the text's own compressed
share (which tells repetition, where both dictionaries do well), goes through a
logistic calibration.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample

#: Bytes of a dictionary, and of the pieces compressed one by one (within a long piece the dictionary would fade).
DICTIONARY, PIECE = 110 << 10, 2048
#: Learning samples: bytes of a sample, and samples of one document, spread over all of it.
SAMPLE, PER_DOCUMENT = 1024, 8
LEVEL = 3


@dataclass
class QualityModel:
    """Two dictionaries (raw bytes, None if there was nothing to learn) and the calibration."""

    good: bytes | None
    bad: bytes | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float = 0.5


def spread(data: bytes, most: int = PER_DOCUMENT) -> list[bytes]:
    """All pieces of ``SAMPLE`` bytes of a short text; of a long one ``most``, at even distances from its beginning to its end."""
    n = -(-len(data) // SAMPLE)
    places = range(n) if n <= most else [i * (n - 1) // max(1, most - 1) for i in range(most)]
    return [data[i * SAMPLE : (i + 1) * SAMPLE] for i in places]


def dictionary(texts: list[str], per_document: int = PER_DOCUMENT) -> bytes:
    """A zstandard dictionary of the texts; the plain text itself where too little is there to train on."""
    samples = [piece for t in texts for piece in spread(t.encode("utf-8", "replace"), per_document)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 4), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of a text under a pair of dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}
        self.by = []
        for d in (good, bad):
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=known, **plain))
        self.own = zstandard.ZstdCompressor(level=LEVEL, **plain)

    def features(self, text: str) -> list[float]:
        data = text.encode("utf-8", "replace")
        good = bad = 0
        for i in range(0, len(data), PIECE):
            piece = data[i : i + PIECE]
            good += len(self.by[0].compress(piece))
            bad += len(self.by[1].compress(piece))
        n = max(1, len(data))
        d = (good - bad) / max(1, good, bad)
        own, best = math.log((len(self.own.compress(data)) + 1) / n), math.log(max(1, min(good, bad)) / n)
        return [d, own, best, d * d, own * own, best * best, d * own, d * best, own * best]


def fit(rows: list[tuple[str, int]], ridge: float = 1.0, rounds: int = 25, per_document: int = PER_DOCUMENT) -> QualityModel:
    """Dictionaries of all rows; calibration on rows that their dictionaries have not seen.

    ``rows``: (text, 0 or 1), bounded by the caller.  Each half is measured with the
    dictionaries of the other half; both labels weigh the same.  Without rows of both
    labels the model is constant.
    """
    if min((sum(y == k for _, y in rows) for k in (0, 1)), default=0) < 2:
        share = sum(y for _, y in rows) / len(rows) if rows else 0.5
        return QualityModel(None, None, np.zeros(0), np.zeros(0), np.zeros(0), share)
    by = {k: [t for t, y in rows if y == k] for k in (0, 1)}
    x, y = [], []
    for half in (0, 1):
        sizes = Sizes(dictionary(by[1][half::2], per_document), dictionary(by[0][half::2], per_document))
        for k in (0, 1):
            x += [sizes.features(t) for t in by[k][1 - half :: 2]]
            y += [k] * len(by[k][1 - half :: 2])
    a, t = np.array(x), np.array(y, float)
    mean, scale = a.mean(0), a.std(0) + 1e-9
    a = np.c_[np.clip((a - mean) / scale, -4, 4), np.ones(len(a))]
    even = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (even * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, a.T @ (even * (t - p)) - ridge * w)
    return QualityModel(dictionary(by[1], per_document), dictionary(by[0], per_document), mean, scale, w)


def train(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int | None = 0, per_class: int = 2000, max_chars: int = 60_000, per_document: int = PER_DOCUMENT) -> QualityModel:
    """Model from a bounded sample: ``per_class`` labelled documents of each label of up to
    ``max_chars`` characters, and for the dictionaries ``per_document`` kilobytes of each, spread over it."""
    return fit(labelled_sample(documents, labels, "quality", folds, held_out, per_class, max_chars), per_document=per_document)


def score_of(text: str | None, model: QualityModel, sizes: Sizes | None) -> float:
    if sizes is None:
        return model.constant
    a = np.clip((np.array(sizes.features(text or "")) - model.mean) / model.scale, -4, 4)
    return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(a @ model.weights[:-1]) + model.weights[-1])))))


def quality(spark: SparkSession, text: Column, model: QualityModel) -> Column:
    """Score (0 to 1, higher: good likelier) of each whole text; a null text counts as empty."""
    sent = spark.sparkContext.broadcast(model)  # two dictionaries of fixed size

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        sizes = Sizes(m.good, m.bad) if m.good is not None and m.bad is not None else None
        for batch in texts:
            yield pa.array([score_of(t.as_py(), m, sizes) for t in batch], pa.float64())

    return score.asNondeterministic()(text)

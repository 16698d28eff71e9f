"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability (logistic in the
sum of its words' weights) and the document's is their noisy-or,
``1 - prod(1 - p)``, so the model is trained from document labels alone and still
says which sentences offend.  A sentence without any known feature is no evidence
(p = 0), so a long text does not turn toxic by its length.  A word's weight is the sum over its features: the
word, its beginnings of 3 to 6 and its endings of 4 letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: Words whose weight a Python worker remembers before it starts anew.
MEMO = 300_000


@dataclass
class ToxicityModel:
    """``weights``: feature to weight; ``bias``: what is added to the weights of a sentence;
    ``constant``: the score of every text where there were not two labels to learn."""

    weights: dict[str, float]
    bias: float
    constant: float | None = None


def features(word: str) -> list[str]:
    n = len(word)
    return [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5, 6) if n > k), *([f"${word[-4:]}"] if n > 4 else [])]


def evidence(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratio (G test) that a feature's documents differ by label."""
    n, total = n_pos + n_neg, pos + neg
    out = np.zeros(len(pos))
    for part, size in ((pos, n_pos), (neg, n_neg)):
        for seen, all_seen in ((part, total), (size - part, n - total)):
            expected = all_seen * size / n
            out += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return out


def fit(rows: list[tuple[str, int]], rounds: int = 200, rate: float = 0.1, l2: float = 1e-4, least: float = 15.0) -> ToxicityModel:
    """Noisy-or likelihood of the document labels, by full-batch Adam.

    ``rows``: (text, 0 or 1), bounded by the caller.  ``least``: evidence (G test)
    that a feature's documents differ by label, below which it gets no weight.
    Without rows of both labels every text has one score (0.98 if all are toxic, else 0).
    """
    if len({y for _, y in rows}) < 2:
        only = rows[0][1] if rows else 0
        return ToxicityModel({}, 4.0 if only else -6.0, constant=0.98 if only else 0.0)
    # two passes over the texts, so that only numbers are held: which features tell the labels apart, then where they stand
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for text, label in rows:
        seen[label].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    every = sorted(seen[0].keys() | seen[1].keys())
    y = np.array([v for _, v in rows], float)
    proof = evidence(np.array([seen[1][f] for f in every], float), np.array([seen[0][f] for f in every], float), int(y.sum()), int((1 - y).sum()))
    names = [f for f, g in zip(every, proof, strict=True) if g >= least]
    del seen, every, proof
    index = {f: i for i, f in enumerate(names)}
    col, row, doc, s = [], [], [], 0
    for d, (text, _) in enumerate(rows):
        for m in SENTENCE.finditer(text):
            found = {index[f] for w in set(WORD.findall(m[0].lower())) for f in features(w) if f in index}
            if not found:
                continue
            col.extend(sorted(found))
            row.extend([s] * len(found))
            doc.append(d)
            s += 1
    col, row, doc = np.array(col, np.int32), np.array(row, np.int32), np.array(doc, np.int32)
    if not s:
        return ToxicityModel({}, -6.0)
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    theta, bias = np.zeros(len(names)), -4.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, theta[col], minlength=s)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        some = np.clip(-np.expm1(log_none), 1e-9, 1)
        up = np.where(y == 1, (1 - some) / some, -1.0) * balance
        gz = p * up[doc]
        g = np.append(np.bincount(col, gz[row], minlength=len(names)) - l2 * len(y) * theta, gz.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        theta, bias = theta + step[:-1], bias + step[-1]
    return ToxicityModel({f: float(w) for f, w in zip(names, theta, strict=True) if abs(w) > 1e-2}, float(bias))


def train(documents: DataFrame, labels: DataFrame, folds: int = 3, held_out: int | None = 1, per_class: int = 1500, max_chars: int = 60_000) -> ToxicityModel:
    """Model from a bounded sample (``per_class`` labelled documents of each label)."""
    return fit(labelled_sample(documents, labels, "toxic", folds, held_out, per_class, max_chars))


class _Weights(dict):
    """The weighted features of each word met, worked out once."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[tuple[str, float], ...]:
        get = self.weights.get
        self[word] = known = tuple((f, w) for f in features(word) if (w := get(f)) is not None)
        return known


def judge(text: str | None, model: ToxicityModel, memo: _Weights, at: float) -> tuple[float, list[dict]]:
    """(probability, sentences of probability ``at`` or more) of one text."""
    if model.constant is not None:
        return model.constant, []
    log_none, found = 0.0, []
    for m in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(m[0].lower()))
        # a feature counts once a sentence, as in training, also where words share a beginning
        known: dict[str, float] = {}
        for features_of in filter(None, map(memo.__getitem__, words)):
            known.update(features_of)
        if not known:
            continue
        z = model.bias + math.fsum(known.values())
        p = 1 / (1 + math.exp(-z)) if z > -30 else 0.0
        log_none += math.log1p(-min(p, 1 - 1e-9))
        if p >= at:
            found.append({"start": m.start(), "end": m.end(), "p": p})
    return max(0.0, -math.expm1(log_none)), found


RESULT = "score double, offending array<struct<start: int, end: int, p: double>>"


def toxicity(spark: SparkSession, text: Column, model: ToxicityModel, at: float = 0.5) -> Column:
    """Struct column of ``score`` and the ``offending`` sentences (code point spans) of a text.

    A null, empty or wordless text scores 0 and offends nowhere.
    """
    sent = spark.sparkContext.broadcast(model)  # bounded by the training sample

    @F.arrow_udf(RESULT)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _Weights(sent.value.weights)
        for batch in texts:
            out = []
            for t in batch:
                s, found = judge(t.as_py(), sent.value, memo, at)
                out.append({"score": s, "offending": found})
                if len(memo) > MEMO:
                    memo.clear()
            yield pa.array(out, pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))]))

    return score.asNondeterministic()(text)


def score_documents(documents: DataFrame, model: ToxicityModel, out: str, text: str = "text") -> DataFrame:
    """``documents`` with the struct column ``out``; no shuffle, other columns stay in the JVM."""
    return documents.withColumn(out, toxicity(documents.sparkSession, F.col(text), model))

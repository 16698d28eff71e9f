"""Language of each word of code-switched text by a linear-chain conditional random field.

Features of a word are its affixes, its inner n-grams and the lexicons it stands in;
transitions between the languages of neighbouring words are learned with them.
Forward-backward gives each word's probabilities, and a document's language is the
one with the most expected words.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, sampled

WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts written without spaces: Thai, Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: A longer run of letters, or one of an unspaced script, is read in pieces of up to PIECE letters.
LONGEST, PIECE = 40, 8
#: Learning: sequences, words of a sequence, words of a stretch of one language in it.
SEQUENCES, LENGTH, STRETCH = 1500, 60, (6, 25)
#: Words a Python worker remembers; words of documents worked on at a time.
MEMO, AT_ONCE = 300_000, 400_000


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text, every letter in one of them.

    A run without spaces is no word but a passage: it is cut into consecutive pieces of
    nearly equal length, so that all of it is read and it weighs by its letters.
    """
    out: list[str] = []
    found = WORD.findall(text.lower())
    if not text.isascii():  # fractions, superscripts, Roman and circled numbers are no letters
        found = [part for w in found for part in ([w] if w.isascii() or w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    for w in found:
        if len(w) > LONGEST or (len(w) > PIECE and not w.isascii() and UNSPACED.search(w)):
            n = -(-len(w) // PIECE)
            out += [w[i * len(w) // n : (i + 1) * len(w) // n] for i in range(n)]
        else:
            out.append(w)
    return out


def features(w: str, lexicons: dict[str, list[str]]) -> list[str]:
    """Affixes of 1 to 3 letters, inner trigrams, and lexicons of a lower-cased word."""
    out = [f"^{w[:k]}" for k in (1, 2, 3) if len(w) >= k] + [f"{w[-k:]}$" for k in (1, 2, 3) if len(w) >= k]
    out += [w[i : i + 3] for i in range(1, len(w) - 3)]
    return out + lexicons.get(w, [])


@dataclass
class LanguageModel:
    """``weights``: feature to a value for each language; ``change``: (from, to) log weights."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    change: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    lexicons: dict[str, list[str]] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log weight of each language for each word, without its neighbours."""
        if not hasattr(self, "table"):
            self.place = {f: i for i, f in enumerate(self.weights, 1)}
            self.table = np.vstack([np.zeros(len(self.languages)), *self.weights.values()])
        find, ids, ends = self.place.get, [], []
        for w in words:
            ids.append(0)
            ids += [i for f in features(w, self.lexicons) if (i := find(f))]
            ends.append(len(ids))
        return np.add.reduceat(self.table[ids], [0, *ends[:-1]], 0) if words else self.table[:0]


def lexicons_of(words: dict[str, Counter], size: int = 2000) -> dict[str, list[str]]:
    """The most frequent words of each language, as ``word: [feature, ...]``."""
    out: dict[str, list[str]] = {}
    for language, count in sorted(words.items()):
        for w, n in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:size]:
            if n > 1:
                out.setdefault(w, []).append(f"lexicon:{language}")
    return out


def marginals(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Probabilities of each word's languages by forward-backward, for many chains at once.

    ``e``: log emissions of all words, chain after chain; ``starts``, ``lengths`` of the
    chains, longest first.  A step works on the chains that are that long.
    """
    move = np.exp(change)
    emit = np.exp(e - e.max(1, keepdims=True))
    ahead, behind = np.empty_like(emit), np.ones_like(emit)
    longest = int(lengths[0]) if len(lengths) else 0
    # chains that reach step t: lengths descend
    reach = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        at = starts[: reach[t]] + t
        a = emit[at] if t == 0 else (ahead[at - 1] @ move) * emit[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = starts[: reach[t + 1]] + t
        b = (behind[at + 1] * emit[at + 1]) @ move.T
        behind[at] = b / b.sum(1, keepdims=True)
    out = ahead * behind
    return out / out.sum(1, keepdims=True)


def _pair_sums(e: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals, expected transitions, log partition) of chains of equal length: ``e`` is (chains, steps, languages)."""
    n, steps, _ = e.shape
    move, top = np.exp(change), e.max(2, keepdims=True)
    emit, total = np.exp(e - top), float(top.sum())
    ahead, behind = np.empty_like(e), np.ones_like(e)
    for t in range(steps):
        a = emit[:, t] if t == 0 else (ahead[:, t - 1] @ move) * emit[:, t]
        s = a.sum(1, keepdims=True)
        ahead[:, t], total = a / s, total + float(np.log(s).sum())
    expected = np.zeros_like(change)
    for t in range(steps - 2, -1, -1):
        after = behind[:, t + 1] * emit[:, t + 1]
        joint = ahead[:, t, :, None] * move[None] * after[:, None, :]
        expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = after @ move.T
        behind[:, t] = b / b.sum(1, keepdims=True)
    out = ahead * behind
    return out / out.sum(2, keepdims=True), expected, total


def fit(rows: list[tuple[str, str]], rounds: int = 60, rate: float = 0.1, l2: float = 1e-3, seed: int = 7) -> LanguageModel:
    """Likelihood of code-switched sequences, by full-batch Adam.

    ``rows``: (text, language), bounded by the caller.  The sequences are spliced from
    stretches of documents of different languages, so that transitions are learned too.
    """
    docs: dict[str, list[list[str]]] = {}
    for text, language in rows:
        if words := words_of(text):
            docs.setdefault(language, []).append(words)
    languages = sorted(docs)
    if len(languages) < 2:
        return LanguageModel(languages)
    lexicons = lexicons_of({k: Counter(w for d in ds for w in d) for k, ds in docs.items()})
    rng, words, truth = random.Random(seed), [], []
    for _ in range(SEQUENCES):
        seq, lab = [], []
        while len(seq) < LENGTH:
            k = rng.randrange(len(languages))
            d = rng.choice(docs[languages[k]])
            at = rng.randrange(len(d))
            part = d[at : at + rng.randint(*STRETCH)]
            seq += part
            lab += [k] * len(part)
        words.append(seq[:LENGTH])
        truth.append(lab[:LENGTH])
    kinds = sorted({w for s in words for w in s})
    place = {w: i for i, w in enumerate(kinds)}
    of = [features(w, lexicons) for w in kinds]
    count = Counter(f for fs in of for f in set(fs))
    names = sorted(f for f, n in count.items() if n > 1)
    index = {f: i for i, f in enumerate(names)}
    row = np.array([i for i, fs in enumerate(of) for f in fs if f in index], np.int32)
    col = np.array([index[f] for fs in of for f in fs if f in index], np.int32)
    x, y = np.array([[place[w] for w in s] for s in words]), np.array(truth)
    n = len(languages)
    observed = np.zeros((n, n))
    np.add.at(observed, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    w, change = np.zeros((len(names), n)), np.zeros((n, n))
    m, v = [np.zeros_like(w), np.zeros_like(change)], [np.zeros_like(w), np.zeros_like(change)]
    for t in range(1, rounds + 1):
        by_kind = np.stack([np.bincount(row, w[col, k], len(kinds)) for k in range(n)], 1).astype(float)
        p, expected, _ = _pair_sums(by_kind[x], change)
        miss = -p
        np.put_along_axis(miss, y[:, :, None], np.take_along_axis(miss, y[:, :, None], 2) + 1, 2)
        by_word = np.stack([np.bincount(x.ravel(), miss[:, :, k].ravel(), len(kinds)) for k in range(n)], 1)
        grads = (np.stack([np.bincount(col, by_word[row, k], len(names)) for k in range(n)], 1).reshape(len(names), n) / x.size - l2 * w, (observed - expected) / x.size - l2 * change)
        for i, (g, target) in enumerate(zip(grads, (w, change), strict=True)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            target += rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-5)
    return LanguageModel(languages, {f: w[i].astype(np.float32) for i, f in enumerate(names)}, change, lexicons)


def train(documents: DataFrame, folds: int = 4, held_out: int | None = 2, per_language: int = 300, max_chars: int = 60_000, most_languages: int = 200, in_all: int = 20_000) -> LanguageModel:
    """Model from a bounded sample (``per_language`` documents of each language outside the held-out fold).

    The ``most_languages`` languages with the most documents are learned, from ``in_all``
    documents together; texts above ``max_chars`` are not learned from."""
    rows = documents.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null")
    if held_out is not None:
        rows = rows.where(fold_of(F.col("doc_id"), folds) != held_out)
    some = sampled(rows, "lang", per_language, ("doc_id", "text"), most_languages, in_all).where(F.length("text") <= max_chars)
    got = some.distinct().collect()  # rows that repeat are one
    return fit([(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))])


class Tagger:
    """Applies a model, remembering the emission of each word."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.new: list[str] = []
        self.table = np.zeros((0, len(self.model.languages)))
        new = self.new

        class Places(dict):
            def __missing__(self, word: str) -> int:
                self[word] = at = len(self)
                new.append(word)
                return at

        self.places = Places()

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Language probabilities of every word of each text (lists of words, none empty)."""
        if len(self.places) > MEMO:
            self._clear()
        find = self.places.__getitem__
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        ids = np.concatenate([np.fromiter(map(find, texts[i]), np.int64, len(texts[i])) for i in order])
        if self.new:
            self.table = np.vstack([self.table, self.model.emissions(self.new)])
            self.new.clear()
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        p = marginals(self.table[ids], starts, lengths, self.model.change)
        out: list[np.ndarray] = [p[:0]] * len(texts)
        for i, s, n in zip(order, starts, lengths, strict=True):
            out[i] = p[s : s + n]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its mean probability over the words) of each text; ``und``, 0 without a letter."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        names = self.model.languages
        some: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            for (i, _), p in zip(some, self.tag([w for _, w in some]), strict=True):
                mean = p.mean(0)
                k = int(mean.argmax())
                out[i] = (names[k], float(mean[k]))

        for i, text in enumerate(texts):
            words = words_of(text or "")
            if not words or not names:
                continue
            if len(names) == 1:
                out[i] = (names[0], 1.0)
                continue
            some.append((i, words))
            held += len(words)
            if held >= AT_ONCE:
                flush()
                some, held = [], 0
        if some:
            flush()
        return out


def language(spark: SparkSession, text: Column, model: LanguageModel) -> Column:
    """Struct column of the predicted ``lang`` and its ``score``; ``und`` for null or letterless texts."""
    sent = spark.sparkContext.broadcast(model)  # bounded by the training sample

    @F.arrow_udf("lang string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(sent.value)
        for batch in texts:
            found = tagger.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["lang", "score"])

    return predict.asNondeterministic()(text)

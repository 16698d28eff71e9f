"""Toxicity: held-out accuracy, located sentences, odd rows."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from kindsort.llm import toxicity
from kindsort.llm.common import labelled_sample
from kindsort.llm.queries import op4_toxicity


def corpus(n, seed=3):
    """Documents of random sentences; toxic ones hold a bad word, or an inflected bad stem, in one sentence."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        sentences = [[rng.choice(plain) for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(1, 12))]
        toxic = int(i % 4 == 0)
        if toxic:
            bad = rng.choice(["vilex", "grumpf", "zorgab" + rng.choice(plain)])
            s = rng.choice(sentences)
            s.insert(rng.randrange(len(s)), bad)
        rows.append((". ".join(" ".join(s) for s in sentences) + ".", toxic))
    return rows


def test_held_out_and_sentences():
    model = toxicity.fit(corpus(800))
    memo = toxicity._Weights(model.weights)
    for text, toxic in corpus(400, seed=4):
        p, found = toxicity.judge(text, model, memo, 0.5)
        assert (p >= 0.7) == bool(toxic), text
        for s in found:
            assert any(b in text[s["start"] : s["end"]] for b in ("vilex", "grumpf", "zorgab"))
        assert bool(found) == bool(toxic)


def test_length_is_no_evidence():
    model = toxicity.fit(corpus(800))
    memo = toxicity._Weights(model.weights)
    clean = " ".join(t for t, y in corpus(3000, seed=5) if not y)
    assert toxicity.judge(clean, model, memo, 0.5)[0] < 0.3


def test_constant_without_both_labels():
    assert toxicity.judge("a b", toxicity.fit([]), toxicity._Weights({}), 0.5)[0] < 0.1
    assert toxicity.judge("a b", toxicity.fit([("x", 0)] * 5), toxicity._Weights({}), 0.5)[0] < 0.1


def test_all_labels_toxic():
    model = toxicity.fit([("x y", 1)] * 5)
    for text in ("a b", "", None, "x y"):
        assert toxicity.judge(text, model, toxicity._Weights(model.weights), 0.5)[0] > 0.9


def plain_score(text, model):
    """The trained model written out: noisy-or over sentences of the logistic of the summed weights of their distinct features."""
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        seen = {f for w in re.findall(r"\w+", sentence.lower()) for f in toxicity.features(w)} & model.weights.keys()
        if seen:
            none *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights[f] for f in seen))))
    return 1 - none


def test_scores_equal_a_plain_version(spark, make, folder):
    """Also where the words of one sentence share beginnings and endings, which count once."""
    rows = corpus(600) + [("zorgaban zorgabel zorgabin zorgabor " * 9 + "zorgabun", 1), ("mitten mitteln mitternacht", 0)] * 20
    sf = folder(documents=make([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), labels=make([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in op4_toxicity(spark, sf).collect()}
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), folds=3, held_out=1)
    for i, (t, _) in enumerate(rows):
        assert got[i] == pytest.approx(plain_score(t, model), abs=1e-9)


def test_rows_that_share_an_id_are_learned_from_once(make):
    docs = make([(1, f"t{i}") for i in range(5000)] + [(2, "b")], "doc_id long, text string")
    labels = make([(1, 1, 0)] * 40 + [(2, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(labelled_sample(docs, labels, "toxic", 3, None, 10, 100)) == 2


def test_memo_starts_anew(spark, make, monkeypatch):
    model = toxicity.fit(corpus(400))
    texts = corpus(40, seed=6)
    docs = make([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(1)
    want = [toxicity.judge(t, model, toxicity._Weights(model.weights), 0.5)[0] for t, _ in texts]
    got = {r["doc_id"]: r["x"]["score"] for r in toxicity.score_documents(docs, model, "x").collect()}
    assert [got[i] for i in range(len(want))] == pytest.approx(want)


def test_odd_rows(spark, make):
    model = toxicity.fit(corpus(400))
    rows = [(1, None, "a"), (2, "", None), (None, "...!!\n", "b"), (4, "vilex", "c"), (4, "vilex", "c"), (5, "la " * 100_000, "d")]
    out = toxicity.score_documents(make(rows, "doc_id long, text string, score string"), model, "tox")
    got = [(r["doc_id"], r["score"], r["tox"]["score"] >= 0.7) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "a", False), (2, None, False), (None, "b", False), (4, "c", True), (4, "c", True), (5, "d", False)], key=str)
    assert toxicity.score_documents(make([], "doc_id long, text string"), model, "tox").count() == 0


def test_query(spark):
    got = op4_toxicity(spark, SF_ORACLE).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF_ORACLE}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    kept = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in kept) / len(kept) > 0.95
    assert not any(p and not y for p, y in kept)


def test_no_labels(spark, make, folder):
    sf = folder(documents=make([(1, "a b")], "doc_id long, text string"), labels=make([], "doc_id long, quality int, toxic int"))
    assert [(r["doc_id"], r["predicted"]) for r in op4_toxicity(spark, sf).collect()] == [(1, 0)]
    assert F.col  # the query needs no other table

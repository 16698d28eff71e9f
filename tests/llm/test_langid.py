"""Language identification: the field against enumeration, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from kindsort.llm import langid
from kindsort.llm.queries import op6_language

ROWS = [("the house and the dog with thing", "en"), ("der hund und das haus mit ding", "de")] * 40


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([5, 3, 3, 1])
    starts = np.array([0, 5, 8, 11])
    e, change = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    got = langid.marginals(e, starts, lengths, change)
    for s, n in zip(starts, lengths, strict=True):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(e[s + i, k] for i, k in enumerate(path)) + sum(change[a, b] for a, b in itertools.pairwise(path)))
            for i, k in enumerate(path):
                want[i, k] += w
        assert np.allclose(got[s : s + n], want / want.sum(1, keepdims=True))


def test_gradient_is_the_likelihoods():
    rng = np.random.default_rng(2)
    e, change = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    p, pairs, base = langid._pair_sums(e, change)
    for (i, j) in ((0, 1), (2, 2)):
        more = change.copy()
        more[i, j] += 1e-6
        assert np.isclose((langid._pair_sums(e, more)[2] - base) / 1e-6, pairs[i, j], atol=1e-4)
    more = e.copy()
    more[1, 2, 0] += 1e-6
    assert np.isclose((langid._pair_sums(more, change)[2] - base) / 1e-6, p[1, 2, 0], atol=1e-4)


def test_words_of_switched_text():
    model = langid.fit(ROWS)
    assert (np.diag(model.change) > model.change.max(1) - 1e-9).all()
    text = "the dog and the house der hund und das haus".split()
    p = langid.Tagger(model).tag([text])[0]
    assert [model.languages[k] for k in p.argmax(1)] == ["en"] * 5 + ["de"] * 5


def test_batches_and_memo_do_not_matter(monkeypatch):
    model = langid.fit(ROWS)
    texts = ["the dog", None, "", "12 !", "Haus und HUND", "the " * 500 + "der", "ding"] * 5
    want = langid.Tagger(model).predict(texts)
    monkeypatch.setattr(langid, "AT_ONCE", 3)
    monkeypatch.setattr(langid, "MEMO", 2)
    got = langid.Tagger(model).predict(texts)
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    assert want[1:4] == [("und", 0.0)] * 3


def test_query(spark):
    got = op6_language(spark, SF_ORACLE).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_odd_rows(spark, make):
    model = langid.fit(ROWS)
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "the dog"), (5, "the dog"), (5, "the dog"), (6, "haus " * 100_000), (7, "漢字 _")]
    out = make(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("t", langid.language(spark, F.col("text"), model)).collect()
    assert [r["t"]["lang"] for r in out[:7]] == ["und", "und", "und", "en", "en", "en", "de"] and out[7]["t"]["lang"] in ("en", "de")
    assert all(0 <= r["t"]["score"] <= 1 for r in out)


def test_nothing_or_one_language_to_learn(spark, make, folder):
    schema = "doc_id long, text string, lang string"
    none = folder(documents=make([(1, "abc", None), (2, None, None)], schema))
    assert [r["lang_pred"] for r in op6_language(spark, none).collect()] == ["und", "und"]
    assert langid.Tagger(langid.fit([("abc", "en")] * 3)).predict(["x", "1"]) == [("en", 1.0), ("und", 0.0)]


def test_too_little_to_learn_from_is_no_crash():
    """One-letter documents share no feature: the scores stay numbers."""
    tagger = langid.Tagger(langid.fit([("a", "en"), ("b", "de")]))
    assert all(0 <= s <= 1 for _, s in tagger.predict(["a b", "zzz", "a"]))


def test_every_letter_of_a_run_without_spaces_counts():
    run = "".join(chr(0x4E00 + i) for i in range(1000))
    assert langid.words_of("The " + run)[0] == "the" and "".join(langid.words_of(run)) == run and len(langid.words_of(run)) == 125
    assert "".join(langid.words_of("q" * 95)) == "q" * 95 and langid.words_of("Ab c\u00e9d-" + "x" * 40) == ["ab", "c\u00e9d", "x" * 40]
    assert "xyz$" in langid.features("a" * 60 + "xyz", {})
    rows = [("the house and the dog with thing", "en"), ("\u6f22\u5b57\u306e\u6587\u7ae0\u3092\u8aad\u3080\u4eba\u3068\u672c", "ja")] * 40
    tagger = langid.Tagger(langid.fit(rows))
    assert tagger.predict(["the dog and the house " + rows[1][0] * 900])[0][0] == "ja"
    model = langid.fit(ROWS)
    assert langid.Tagger(model).predict(["the dog and " + "z" * 60 + "derhundunddashausmitding" * 500])[0][0] == "de"


def test_numbers_that_are_no_letters():
    assert langid.words_of("\u00bd x\u00b2 \u2167 \u2460 a\u00bdb \u00e9t\u00e9") == ["x", "a", "b", "\u00e9t\u00e9"]
    assert langid.Tagger(langid.fit(ROWS)).predict(["\u00bd \u00b2 \u2168", "\u2460"]) == [("und", 0.0)] * 2


def test_samples_are_bounded(make):
    rows = [(1, f"the dog number {i}", "en") for i in range(3000)] + [(2 + i, f"haus und hund {i}", f"l{i % 30}") for i in range(90)]
    model = langid.train(make(rows, "doc_id long, text string, lang string"), held_out=None, most_languages=5)
    assert len(model.languages) == 5 and "en" in model.languages

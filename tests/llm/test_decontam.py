"""Spaced-seed decontamination against brute force over all alignments."""

import random
import re
from itertools import combinations

import pytest

from kindsort.llm import decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """{(doc, item): (equal, of, shift)}: every alignment, compared word by word, without seeds."""
    out = {}
    for d, t in docs:
        for i, b in items:
            dw, bw = words(t), words(b)
            if d is None or i is None:
                continue
            for shift in range(-len(bw), len(dw)):
                same = [0 <= j + shift < len(dw) and dw[j + shift] == w for j, w in enumerate(bw)]
                of = min(13, len(bw))
                if sum(same) < 0.75 * of:
                    continue
                equal = max((sum(same[j : j + of]) for j in range(len(bw) - of + 1)), default=0)
                if of and equal >= 0.75 * of:
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (equal, -shift, of))
    return {k: (e, of, -s) for k, (e, s, of) in out.items()}


def found(docs, items):
    return {(r["doc_id"], r["item_id"]): (r["equal"], r["of"], r["doc_word"]) for r in decontam.overlaps(docs, items).collect()}


def text(rng, n):
    return [rng.choice("of the and in")if rng.random() < 0.3 else "".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(make, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(text(rng, rng.choice((3, 7, 8, 14, 30))))) for i in range(12)]
    docs = []
    for d in range(40):
        w = text(rng, rng.choice((0, 5, 20, 60)))
        b = words(rng.choice(items)[1])
        part = b[rng.randrange(len(b)) :] if d % 3 == 0 else list(b)
        part = [x if rng.random() > (0.0, 0.15, 0.3, 0.6)[d % 4] else "zzzz" for x in part]
        at = rng.randrange(len(w) + 1)
        docs.append((d, ", ".join(w[:at] + part + w[at:])))
    got = found(make(docs, DOCS).repartition(3), make(items, ITEMS))
    assert got == brute(docs, items) and got


@pytest.mark.parametrize("every", (3, 4, 5, 7))
def test_every_nth_word_replaced(make, every):
    rng = random.Random(every)
    item = text(rng, 30)
    changed = [w if i % every else "other" for i, w in enumerate(item)]
    got = found(make([(1, " ".join(text(rng, 50) + changed + text(rng, 50))), (2, " ".join(text(rng, 200)))], DOCS), make([(9, " ".join(item))], ITEMS))
    assert set(got) == ({(1, 9)} if every > 3 else set())  # a third replaced is below the share of equal words


@pytest.mark.parametrize("words", range(1, 14))
def test_masks_hit_every_pattern_of_the_rule(words):
    equal = decontam.needed(words, 0.75)
    masks = decontam.covering_masks(words, equal)
    assert len(masks) <= decontam.MASKS
    for bad in combinations(range(words), words - equal):
        assert any(all(o + k not in bad for k, c in enumerate(m) if c == "1") for m in masks for o in range(words - len(m) + 1)), (masks, bad)
    assert decontam.covering_masks(60, 45) == ("111",)  # too many patterns to list: adjacent words, by the pigeonhole principle


@pytest.mark.parametrize("words", (1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 20))
def test_every_replacement_that_the_rule_allows_is_found(make, words):
    """Recall by the rule is 1: all patterns of the first window, also short items word for word."""
    item = [f"w{i}" for i in range(words)]
    of = min(13, words)
    patterns = list(combinations(range(of), of - decontam.needed(of, 0.75)))
    docs = [(i, " ".join(["before"] * 3 + ["zz" if j in bad or j >= of else w for j, w in enumerate(item)] + ["after"] * 3)) for i, bad in enumerate(patterns)]
    got = found(make(docs, DOCS), make([(1, " ".join(item))], ITEMS))
    assert set(got) == {(i, 1) for i in range(len(patterns))}
    assert found(make(docs[:1], DOCS), make([(1, " ".join(f"v{i}" for i in range(words)))], ITEMS)) == {}


def test_repetitive_texts(make):
    """A word that fills the document and the item: shifts are gathered, the words joined once."""
    docs = [(1, "la " * 4000), (2, "la " * 5 + "no " * 50), (3, "no " * 50)]
    got = found(make(docs, DOCS), make([(1, "la " * 60)], ITEMS))
    assert got == {(1, 1): (13, 13, -47)}


def test_odd_rows(make):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, None), (2, ""), (None, passage), (4, passage), (4, passage), (5, "word " * 50_000 + passage), (6, "short"), (4, "another text"), (7, passage.upper().replace(" ", " -- "))]
    items = [(1, passage), (2, passage), (3, None), (None, passage), (4, ""), (5, "too short"), (1, passage)]
    clash = make(docs, DOCS).selectExpr("*", "'x' as item_id", "1 as w", "2 as at", "3 as h", "4 as doc")
    got = found(clash, make(items, ITEMS).selectExpr("*", "'y' as doc_id"))
    assert set(got) == {(d, i) for d in (4, 5, 7) for i in (1, 2)}
    assert set(found(make([(1, "it was too short, far too short")], DOCS), make(items, ITEMS))) == {(1, 5)}
    assert got[5, 1] == (13, 13, 50_000)


def test_empty_tables(make):
    some = "a b c d e f g h i j"
    assert found(make([], DOCS), make([(1, some)], ITEMS)) == {}
    assert found(make([(1, some)], DOCS), make([], ITEMS)) == {}


def test_a_hot_passage(make):
    """Many copies of one passage: one row a document, no pairs of documents."""
    passage = " ".join(f"w{i}" for i in range(40))
    docs = make([(i, passage) for i in range(300)], DOCS)
    assert found(docs, make([(1, passage)], ITEMS)) == {(i, 1): (13, 13, 0) for i in range(300)}


def test_native(make):
    docs, items = make([(1, "a b c")], DOCS), make([(1, "a b c")], ITEMS)
    plan = decontam.overlaps(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

"""SimHash near-duplicates against brute force over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kindsort.llm import simhash
from kindsort.llm.queries import op9_simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    """The contract, a shingle and a bit at a time."""
    words, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(prints):
    """{place: class} of a list of fingerprints, linked at 2 or fewer differing bits, by all pairs."""
    own = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2 and own[i] != own[j]:
                old, new = own[i], own[j]
                own = [new if x == old else x for x in own]
    return own


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_contract():
    for text in (None, "", " \t\n", "One", "one two", "A b C d", "É e f g h", "x " * 500, "Straße İ ſ K " * 9):
        assert simhash.fingerprint_of(text) == plain_fingerprint(text)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(500))
    want = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint_of(text) == want == plain_fingerprint(text)


def test_query_is_brute_force(spark):
    got = {r["doc_id"]: r for r in op9_simhash(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in docs]
    own = classes(prints)
    least = {}
    for r, c in zip(docs, own, strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert len(got) == len(docs)
    for r, p, c in zip(docs, prints, own, strict=True):
        assert (got[r["doc_id"]]["fingerprint"], got[r["doc_id"]]["component_id"]) == (f"{p:016x}", least[c])


@pytest.mark.parametrize("seed", range(3))
def test_links_lose_no_component(spark, make, seed):
    """Crowded groups, chains and lone pairs: the components are those of all pairs."""
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for base in list(prints)[:6]:
        x = base
        for _ in range(rng.choice((1, 2, 40))):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    crowd = rng.getrandbits(64)
    prints |= {crowd ^ (1 << i) for i in range(64)} | {0, 3, (1 << 64) - 1}
    prints = sorted(prints)
    df = make([(signed(p),) for p in prints], "fp long").checkpoint()
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    got = [roots.get(signed(p), signed(p)) for p in prints]
    want = classes(prints)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))
    assert all(roots[k] <= k for k in roots)


def test_no_pairs_of_a_crowd(spark, make):
    """65 fingerprints that are all within 2 bits give a chain a cell, not all 2,080 pairs a cell."""
    crowd = [(signed(1 << i),) for i in range(64)] + [(0,)]
    df = make(crowd, "fp long").checkpoint()
    assert simhash.links(df).count() < 65 * 65
    assert {r["root"] for r in simhash.components(simhash.links(df)).collect()} == {signed(1 << 63)}


def test_odd_rows(spark, make):
    rows = [(1, None), (2, ""), (3, "  "), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "x" * 100_000), (7, "w " * 50_000)]
    got = simhash.near_duplicates(make(rows, SCHEMA).withColumn("fp", F.lit("mine")).withColumn("root", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert {(1, 1), (2, 1), (3, 1), (None, 5), (5, 5)} <= by


def test_empty_table(spark, make):
    assert simhash.near_duplicates(make([], SCHEMA)).count() == 0

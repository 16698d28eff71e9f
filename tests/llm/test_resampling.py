"""Prefix CRCs and resampling against zlib over every n-gram."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindsort.llm import queries, resampling

SCHEMA = "doc_id long, text string"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain(rows, target, percent=25, buckets=10_000):
    bucket = lambda f: crc32(f.encode()) % buckets
    raw = Counter(bucket(f) for _, t in rows for f in features(t))
    goal = Counter(bucket(f) for t in target for f in features(t))
    s_all, t_all = sum(raw.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
    out = []
    for i, t in rows:
        f = features(t)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words_of(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    cut = percent * len(long) // 100
    return sorted([(*r, n + 1 if n < cut else None) for n, r in enumerate(long)] + [(*r, None) for r in out if r[1] < 20], key=str)


def some_rows(rng, n):
    vocabulary = ["the", "Of", "été", "x1", "ßtraße", "\U0001f600", "中文", "a", "ending"]
    seps = [" ", "  ", ", ", "\n", "-", "'", "\x00", "\x7f", "\t_"]
    return [(i, "".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(rng.choice((0, 3, 19, 20, 21, 80))))) for i in range(n)]


def test_every_run_from_two_prefixes():
    rng = random.Random(2)
    texts = [t for _, t in some_rows(rng, 60)] + ["", "one", "w" * 70_000 + " x " + "y" * 300]
    scanned = [resampling.prefixes_of(t.encode()) for t in texts]
    ends = np.array([e for es, _ in scanned for e in es], np.uint32)
    lengths = np.array([n for _, ns in scanned for n in ns], np.int64)
    first = np.array([i == 0 for es, _ in scanned for i in range(len(es))], bool)
    for n, (_, crc) in enumerate(resampling.run_crcs(ends, lengths, first, 5), 1):
        want = [crc32(" ".join(w[i : i + n]).encode()) for t in texts for w in [words_of(t)] for i in range(len(w) - n + 1)]
        assert crc.tolist() == want


@given(st.binary(max_size=40), st.binary(max_size=40), st.integers(0, 1 << 20))
@settings(max_examples=200, deadline=None)
def test_shift_cancels_what_comes_before(a, b, n):
    whole = np.array([crc32(a + b)], np.uint32)
    before = resampling.SHIFTS.shift(np.array([crc32(a)], np.uint32), np.array([len(b)]))
    assert (whole ^ before).tolist() == [crc32(b)]
    zeros = resampling.SHIFTS.shift(np.array([crc32(a)], np.uint32), np.array([n])) ^ np.uint32(crc32(bytes(n)))
    assert zeros.tolist() == [crc32(a + bytes(n))]


@pytest.mark.parametrize("held", [None, 50])
def test_query_equals_plain(make, folder, spark, held, monkeypatch):
    rng = random.Random(4)
    rows = some_rows(rng, 200) + [(500, None), (501, ""), (None, "w " * 30), (None, "w " * 30), (502, "!?"), (7, "again " * 25), (7, "again " * 25), (503, "long é " * 20_000)]
    target = [t for _, t in some_rows(random.Random(8), 10)] + [None, ""]
    at = folder(documents=make(rows, SCHEMA).repartition(6), benchmark=make([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    if held:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(held))
    try:
        got = queries.op13_resampling(spark, at).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(rows, target)
    assert sorted(map(tuple, got), key=str) == sorted(((i, n, w, s, r) for i, _, n, w, s, r in want), key=str)


def test_drawn_documents_look_like_the_target(make):
    rng = random.Random(6)
    kinds = {"law": ["court", "judge", "appeal", "clause"], "food": ["oven", "flour", "sugar", "salt"]}
    text = lambda kind: " ".join(rng.choice(kinds[kind]) for _ in range(40))
    rows = [(i, text("law" if i % 4 == 0 else "food")) for i in range(800)]
    out = resampling.resample(make(rows, SCHEMA), make([(text("law"),) for _ in range(20)], "text string"), percent=20).where("rank is not null").collect()
    assert len(out) == 160 and sorted(r["rank"] for r in out) == list(range(1, 161))
    assert sum(r["doc_id"] % 4 == 0 for r in out) > 120


def test_empty_tables_and_clashing_names(make):
    none = make([], SCHEMA)
    assert resampling.resample(none, none).collect() == []
    df = make([(i, "a b c " * 10) for i in range(4)], SCHEMA).selectExpr("*", "1 as key", "2 as rank", "3 as weight", "4 as ends", "5 as place")
    out = resampling.resample(df, none, percent=50)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] or 0 for r in out.collect()) == [0, 0, 1, 2]


def test_runs_agree_across_partitions(make):
    rows = some_rows(random.Random(11), 120)
    goal = make([("x1 the of",)], "text string")
    one, two = (sorted(map(tuple, resampling.resample(make(rows, SCHEMA).repartition(n), goal).collect()), key=str) for n in (1, 9))
    assert one == two

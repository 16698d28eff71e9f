"""Mixing against a plain water-filling."""

import random
import re
from fractions import Fraction

import pytest

from kindsort.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, weights, epochs=3):
    """{source: exact target}: clamp and reshare until none is above its cap."""
    total, free, out = sum(sizes.values()), dict(weights), {}
    while free:
        left = total - sum(out.values())
        share = {s: Fraction(left * w, sum(free.values())) for s, w in free.items()}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(epochs * sizes[s])
            del free[s]
    return out


def mixed(df, **kw):
    out, m = mixing.mix(df, **kw)
    return [(r["doc_id"], r["source"], r[m]) for r in out.collect()]


def order(sources):
    return sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(make, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        s = rng.choice(["a", "a", "a", "b", "é", "zz", "\U0001f600", "B", "c" * 3, None, "tiny"] if i % 40 else ["rare"])
        rows.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(0 if s == "tiny" else rng.choice((0, 1, 20, 60)))), s))
    got = mixed(make(rows, SCHEMA).repartition(5))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = plain_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order(sizes))})
    taken, most = {}, {}
    for d, s, m in got:
        assert m["size"] == len(rows[d][1].split()) and m["source_size"] == sizes[s]
        assert m["target"] == float(want[s]) if want[s].denominator == 1 else m["target"] == pytest.approx(float(want[s]))
        assert m["taken"] == m["size"] * m["repeats"] <= 3 * m["size"]
        taken[s] = taken.get(s, 0) + m["taken"]
        most[s] = max(most.get(s, 0), m["size"])
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= Fraction(most[s], 2)
    assert sorted(mixed(make(rows, SCHEMA).repartition(2)), key=str) == sorted(got, key=str)


def test_capped_sources_are_taken_three_times(make):
    rows = [(i, "a b", "big") for i in range(50)] + [(100, "x y z", "asmall")]
    by = {d: m for d, _, m in mixed(make(rows, SCHEMA))}
    assert by[100]["taken"] == 9 and by[100]["target"] == 9.0
    assert sum(by[i]["taken"] for i in range(50)) == 94


def test_given_weights_and_missing_source(make):
    rows = [(i, "a b", "ab"[i % 2]) for i in range(40)] + [(99, "q", "other")]
    got = mixed(make(rows, SCHEMA), weights=make([("a", 3), ("b", 1)], "source string, weight long"))
    assert sum(m["taken"] for _, s, m in got if s == "a") == 60 and sum(m["taken"] for _, s, m in got if s == "b") == 20
    assert [m["taken"] for _, s, m in got if s == "other"] == [None]


def test_odd_rows(make):
    rows = [(1, None, None), (None, "a b", None), (3, "", "s"), (4, "\x0b\x1c é", "s"), (4, "\x0b\x1c é", "s"), (5, "w " * 100_000, "long")]
    df = make(rows, SCHEMA).selectExpr("*", "'m' as mix", "7 as size", "1 as target", "2 as mix_by", "3 as mix_source")
    got = mixed(df)
    assert sorted(m["size"] for _, _, m in got) == [0, 0, 2, 2, 2, 100_000]
    out, m = mixing.mix(df)
    assert out.columns == [*df.columns, m]


def test_empty_and_wordless_tables(make):
    assert mixed(make([], SCHEMA)) == []
    assert [m["taken"] for _, _, m in mixed(make([(1, "", "a"), (2, None, None)], SCHEMA))] == [0, 0]


@pytest.mark.parametrize("same_text", (True, False))
def test_rows_that_share_key_and_size_end_where_the_target_does(make, same_text):
    """A third of a source's rows has one key and size: the words taken stay within half a document of the target."""
    rows = [(7, "a b c d e f g h i " + ("j" if same_text else f"j{i}"), "big") for i in range(400)]
    rows += [(1000 + i, "a b c d e f g h i j", "big") for i in range(800)] + [(5000 + i, "x " * 10, "other") for i in range(900)]
    rows += [(None, "n " * 10, None) for _ in range(300)]
    got = mixed(make(rows, SCHEMA).repartition(6))
    for s in ("big", "other", None):
        mine = [m for _, t, m in got if t == s]
        assert abs(sum(m["taken"] for m in mine) - mine[0]["target"]) <= 5
    again = mixed(make(rows[::-1], SCHEMA).repartition(3))
    assert sorted(again, key=str) == sorted(got, key=str)


@pytest.mark.parametrize("name", ("mix_by", "mix_source", "mix_repeats", "mix_at", "mix_number", "mix_size", "__repeats"))
def test_each_clashing_name_alone(make, name):
    df = make([(i % 2, "a b", "s") for i in range(9)] + [(3, "c", "t")], SCHEMA).selectExpr("*", f"'mine' as `{name}`")
    out, m = mixing.mix(df)
    assert out.columns == [*df.columns, m] and {r[name] for r in out.collect()} == {"mine"}


def test_large_source_tables_are_not_broadcast(make, monkeypatch):
    rows = [(i, "a b c", f"s{i % 7}") for i in range(70)]
    want = sorted(mixed(make(rows, SCHEMA)), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(mixed(make(rows, SCHEMA)), key=str) == want


def test_native(make):
    out, _ = mixing.mix(make([(1, "a", "s")], SCHEMA))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

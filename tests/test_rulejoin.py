"""Rule tables joined by rarest gram against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from kindsort.functions import rulejoin as G
from kindsort.operators.classify import component_flags


def plain_first(text, rules):
    found = [r for r in rules if text is not None and r[1] and r[1] in text]
    return min(found)[:3] if found else (None, None, None)


@pytest.mark.parametrize("seed", range(3))
def test_first_match_equals_plain(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé\U0001f600 x") for _ in range(n))
    rules = [(i, word(rng.choice((1, 2, 3, 5, 6, 7, 12))), f"L{i % 5}") for i in range(120)]
    rules += [(500, rules[3][1], "again"), (501, "", "empty"), (502, "never there at all", "no")]
    texts = [(i % 50, word(rng.choice((0, 1, 2, 5, 40, 200)))) for i in range(150)] + [(1, None), (2, rules[0][1]), (2, "zz" + max((r[1] for r in rules[:120]), key=len) + "q")]
    table = spark.createDataFrame([("category", *r) for r in rules] + [("other", 0, "a", "wrong set")], "rule_set string, priority int, keyword string, label string")
    df = spark.createDataFrame(texts, "k int, t string")
    first = {}
    for p, w, lab in sorted(rules):
        first.setdefault(w, (p, w, lab))
    want = sorted(((k, *plain_first(t, list(first.values()))) for k, t in texts), key=str)
    got = G.first_match_by_table(df.repartition(3), "k", "t", table)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_a_million_rules(spark):
    """Every row of texts that hold one to three of a million keywords; no rule reaches the driver, no loop join, no Python."""
    n = 1_000_000
    word = lambda c: F.concat(F.substring(F.sha1(c.cast("string")), 1, 11), F.lit("-"), c.cast("string"))
    rules = spark.range(n).select(F.lit("category").alias("rule_set"), F.col("id").cast("int").alias("priority"), word(F.col("id")).alias("keyword"), F.concat(F.lit("L"), F.col("id") % 10).alias("label"))
    texts = spark.range(2000).select("id", F.concat(F.lit("some text "), word(F.col("id") * 499 + 3), F.lit(" and more")).alias("t"))
    got = G.first_match_by_table(texts, "id", "t", rules)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "Pandas" not in plan
    rows = got.collect()
    # a shorter keyword of the same beginning is contained too; the smallest priority wins
    assert len(rows) == 2000 and all(r.priority is not None and r.priority <= r.id * 499 + 3 for r in rows)
    assert sum(r.priority == r.id * 499 + 3 for r in rows) > 1900


def test_long_texts_take_time_in_proportion(spark):
    rules = spark.createDataFrame([("category", 1, "needle in it", "x"), ("category", 0, "zq", "y")], "rule_set string, priority int, keyword string, label string")
    long = "hay stack é " * 50_000
    df = spark.createDataFrame([(1, long + "needle in it"), (2, long + "zq"), (3, long)], "k int, t string")
    got = {r.k: r.label for r in G.first_match_by_table(df, "k", "t", rules).collect()}
    assert got == {1: "x", 2: "y", 3: None}


def test_components_from_a_table(spark):
    rules = [("Pump", "tubing"), ("pump", "power"), ("ecg", "paper"), ("e", "any")]
    table = spark.createDataFrame(rules, "keyword string, component string")
    rows = [(1, "ECG and PUMP", "i"), (2, "glove", "j"), (3, None, "k"), (4, "", "l"), (5, "ooo", "m"), (1, "ECG and PUMP", "i")]
    df = spark.createDataFrame(rows, "id int, DESCRIPTION string, text string")
    a = component_flags(df, table)
    b = component_flags(df, rules)
    assert a.columns == b.columns == ["id", "DESCRIPTION", "text", "components"]
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert {r.id: r.components for r in component_flags(df, table.limit(0)).collect()} == dict.fromkeys(range(1, 6))


def test_any_match_by_table(spark):
    words = spark.createDataFrame([("pump",), ("x",), ("pump",), (None,), ("",)], "keyword string")
    df = spark.createDataFrame([(1, "a pump"), (2, "glove"), (3, None), (4, "")], "row int, t string")
    assert sorted(map(tuple, G.any_by_table(df, "t", words, "hit").select("row", "hit").collect())) == [(1, True), (2, False), (3, None), (4, False)]


def test_keywords_are_filed_under_their_rarest_gram(spark):
    texts = spark.createDataFrame([(i, "common words") for i in range(20)] + [(99, "common rarexx")], "id int, text string")
    rules = spark.createDataFrame([("common rarexx",), ("unheard of",)], "keyword string")
    (row,) = G.rarest_grams(texts, rules, [6]).collect()
    assert row.keyword == "common rarexx" and row.gram not in "common "

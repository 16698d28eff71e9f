"""The bucketed answer store."""

import tempfile

import pytest
from conftest import inventory
from pyspark.sql import functions as F

from kindsort.functions.vocab import CATEGORY_COL
from kindsort.operators import classify as C
from kindsort.operators import enrich as L
from kindsort.sinks.store import AnswerStore

SCHEMA = "request_id string, response string"


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="kindsort-test-", dir="/tmp") + "/store"


def held(store):
    return {r.request_id: r.response for r in store.answers().collect()}


def test_batches_merge_and_the_latest_answer_wins(spark, path):
    store = AnswerStore(spark, path, buckets=4, merge_after=3)
    assert held(store) == {}
    want = {}
    for b in range(8):
        rows = [(f"r{i}", f"b{b}") for i in range(b, b + 4)] + [("same", None if b == 5 else f"s{b}"), ("same", "a")]
        store.append(spark.createDataFrame(rows, SCHEMA), b)
        want |= {r: x for r, x in rows[:4]} | {"same": "a" if b == 5 else f"s{b}"}
        assert held(store) == want
        assert len(store.batches()) < 3
    again = AnswerStore(spark, path, buckets=99)  # another session finds the same buckets
    assert again.buckets == 4 and held(again) == want
    with pytest.raises(ValueError):
        again.append(spark.createDataFrame([("x", "y")], SCHEMA), 1)


def test_a_repeated_batch_replaces_itself_and_an_unfinished_base_does_not_count(spark, path):
    store = AnswerStore(spark, path, buckets=4, merge_after=9)
    for text in ("first", "second"):
        store.append(spark.createDataFrame([("r", text)], SCHEMA), 1)
    assert held(store) == {"r": "second"}
    store.merge()
    spark.createDataFrame([("r", "half")], SCHEMA).write.parquet(f"{path}/base/upto-7-buckets-4/unfinished")
    assert held(store) == {"r": "second"} and store.batches() == []


def test_the_base_is_not_moved(spark, path):
    """A look-up exchanges the asking rows alone; a merge reads no older batch."""
    store = AnswerStore(spark, path, buckets=4, merge_after=5)
    for b in range(10):
        store.append(spark.range(b * 50, b * 50 + 50).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit(f"x{b}").alias("response")), b)
    assert store.batches() == []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asking = spark.range(600).select(F.concat(F.lit("r"), "id").alias("rid"), "id").checkpoint()
        found = store.look_up(asking, "rid")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(rid" in plan and "Aggregate" not in plan
        got = {r.id: r.response for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: f"x{i // 50}" if i < 500 else None for i in range(600)}


def test_answers_from_the_store_label_rows(spark, path):
    df = inventory(spark, [("spare bracket", None, None), ("spare bracket", None, None), ("foam cushion", None, None), ("glove", None, None)])
    stored = C.categorize(df, trace=True).checkpoint()
    store = AnswerStore(spark, path, buckets=2)
    none = C.apply_answers(stored, "category", store)
    assert none.where(F.col(CATEGORY_COL) == "Needs Review").count() == 3
    reqs = L.pending(L.requests(stored, "category")).where(F.col("context").contains("spare"))
    store.append(reqs.select("request_id", F.lit("PPE & Infection Control").alias("response")), 1)
    for _ in range(2):
        got = sorted((r.DESCRIPTION, r[CATEGORY_COL]) for r in C.apply_answers(stored, "category", store).collect())
        assert [c for d, c in got if d == "spare bracket"] == ["PPE & Infection Control"] * 2 and ("foam cushion", "Needs Review") in got and len(got) == 4
        store.merge()

"""Plan shape: what is read, shuffled and gathered how often."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import inventory
from kindsort.functions.vocab import CATEGORY_COL, FACILITY_COL
from kindsort.operators import classify as C
from kindsort.operators import enrich as L
from kindsort.operators import report as R


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def logged(spark):
    """Counts how often a marked row function runs: once a row and pass over the input."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def mark(x):
        seen.add(1)
        return x

    return seen, mark.asNondeterministic()


@pytest.mark.parametrize("report", ("category", "summary"))
def test_counts_read_their_input_once(spark, logged, report):
    seen, mark = logged
    df = inventory(spark, [("glove", None, None), ("mask", None, None), ("bracket", None, None)] * 20)
    df = C.facility(C.categorize(df)).withColumn("DESCRIPTION", mark("DESCRIPTION")).withColumn(CATEGORY_COL, mark(F.col(f"`{CATEGORY_COL}`")))
    out = R.distribution(df, CATEGORY_COL) if report == "category" else R.summary_report(df, "DESCRIPTION", skip_descriptions=True)
    out.collect()
    assert seen.value == 60  # the label of each row, once


def test_many_labels_meet_in_no_single_task(spark):
    df = spark.range(100_000).select(F.concat(F.lit("label "), F.col("id").cast("string")).alias(CATEGORY_COL), F.lit("Both").alias(FACILITY_COL))
    dist = R.distribution(df, CATEGORY_COL)
    plan = _final_plan(dist)
    # the total is gathered from partial sums: one row a task
    assert "Window" not in plan
    assert all("partial_sum" in plan[m.start():m.start() + 400] for m in re.finditer("SinglePartition", plan))
    assert dist.count() == 100_000 and R.ranked(dist).where("rank = 100000").count() == 1


def test_small_answers_move_no_row(spark):
    df = inventory(spark, [("spare bracket", "Acme", None), ("glove", None, None)] * 50)
    reqs = L.pending(L.requests(C.categorize(df, trace=True), "category"))
    ans = reqs.select("request_id", F.lit("PPE & Infection Control").alias("response"))
    plan = _final_plan(C.categorize(df, completions=ans))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_large_answers_shuffle_open_rows_only(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    df = inventory(spark, [("spare bracket", "Acme", None)] * 30 + [(f"foam cushion {i}", None, None) for i in range(30)] + [("glove", None, None)] * 60)
    reqs = L.pending(L.requests(C.categorize(df, trace=True), "category"))
    ans = reqs.select("request_id", F.lit("PPE & Infection Control").alias("response"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.categorize(df, completions=ans)
        got = {r[0]: r[1] for r in out.groupBy(CATEGORY_COL).count().collect()}
        plan = _final_plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"PPE & Infection Control": 60, "Medical & Surgical Supplies": 60}
    assert plan.count("SortMergeJoin") == 1 and "isnotnull(_cat_rid" in plan.lower() and "Union" in plan


def test_a_hot_request_is_split(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    held = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, F.lit("spare bracket")).otherwise(F.concat(F.lit("foam cushion "), F.col("id").cast("string"))).alias("DESCRIPTION"),
        F.lit("Acme").alias("VENDOR_NAME"), F.md5(F.col("id").cast("string")).alias("filler"),
    ).repartition(8)
    reqs = L.pending(L.requests(C.categorize(rows, trace=True), "category"))
    ans = reqs.select("request_id", F.lit("PPE & Infection Control").alias("response"))
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        plan = _final_plan(C.categorize(rows, completions=ans))
    finally:
        for k in held:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert "skew=true" in plan


def test_first_rows_sort_nothing(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"), F.lit("x").alias("payload"))
    out = L.first_rows(df, ["k"], 10)
    plan = _final_plan(out)
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert sorted((r["k"], r["_row"]) for r in out.where("_row is not null").collect()) == [(i, i) for i in range(10)] and out.count() == 1000

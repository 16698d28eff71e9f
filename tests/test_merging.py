"""Profiles and samples that merge, SQL functions and views, answers on stored rows."""

import pytest
from conftest import inventory
from pyspark.sql import functions as F

from kindsort.functions.sqlfunctions import literal, register_functions, register_results
from kindsort.functions.vocab import CATEGORY_COL, FACILITY_COL
from kindsort.operators import classify as C
from kindsort.operators import enrich as L
from kindsort.operators import report as R
from kindsort.sources import inventory as S

ROWS = [("Nitrile glove", "A", None), ("syringe PUMP", None, "x"), ("", "B", "s"), (None, "B", "s"), ("odd thing", "C", "Wheelchair parts"), ("it's a \\ quote", "", ""), ("zzz", "D", None), ("zzz", "D", None)]


def test_profile_of_parts_is_the_profile_of_all(spark):
    df = spark.range(20_000).select(F.concat(F.lit("v"), F.col("id") % 7000).alias("a"), F.when(F.col("id") % 10 < 6, "often").otherwise(F.col("id").cast("string")).alias("b"), F.when(F.col("id") % 4 == 0, "x").alias("c"))
    parts = [S.profile_state(df.where(F.pmod(F.xxhash64("a", "b"), F.lit(4)) == i)) for i in range(4)]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    got = {r.column: r for r in S.merged_profile(states.checkpoint()).collect()}
    exact = {r.column: r for r in S.profile(df).collect()}
    for c in "abc":
        assert got[c].rows == 20_000 and got[c].non_null == exact[c].non_null
        assert abs(got[c].distinct_values - exact[c].distinct_values) <= 0.05 * exact[c].distinct_values
    assert got["b"].frequent[0][0] == "often" and got["b"].frequent[0][1] == 12_000 and got["b"].median_length == 5


def test_a_column_that_a_part_lacks(spark):
    one = S.profile_state(spark.createDataFrame([("a", "b")], "x string, y string"))
    two = S.profile_state(spark.createDataFrame([("a",), (None,)], "x string"))
    got = {r.column: (r.rows, r.non_null, r.distinct_values) for r in S.merged_profile(one.unionByName(two)).collect()}
    assert got == {"x": (3, 2, 1), "y": (1, 1, 1)}
    assert S.merged_profile(one.limit(0)).collect() == []


@pytest.mark.parametrize("by", (None, ["g"]))
def test_sample_of_parts_is_the_sample_of_all(spark, by):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    states = R.sample_state(df.where("id < 10"), "id", 7, 6, by).union(R.sample_state(df.where("id >= 10 and id < 300"), "id", 7, 6, by)).union(R.sample_state(df.where("id >= 300"), "id", 7, 6, by))
    got = sorted(r.id for r in R.merged_sample(states, "id", 6, by).collect())
    if by:
        want = sorted(r.id for g in range(3) for r in R.sample(df.where(F.col("g") == g), "id", 7, 6).collect())
    else:
        want = sorted(r.id for r in R.sample(df, "id", 7, 6).collect())
    assert got == want


def test_sql_functions_equal_the_dataframe_form(spark):
    register_functions(spark)
    df = inventory(spark, ROWS)
    df.createOrReplaceTempView("given")
    got = spark.sql(f"SELECT DESCRIPTION, product_category(DESCRIPTION, SUBCATEGORY) AS c, facility_suitability(DESCRIPTION) AS f, f.* FROM given, LATERAL facility_flags(DESCRIPTION) f")
    want = C.facility(C.categorize(df, trace=True), trace=True).select("DESCRIPTION", CATEGORY_COL, FACILITY_COL, "_fac_review", "_fac_rural", "_fac_district")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Python" not in got._jdf.queryExecution().toString()
    assert spark.sql(f"SELECT {literal('a' + chr(39) + chr(92) + 'b')}").first()[0] == "a'\\b"


def test_views_of_a_result(spark):
    df = C.facility(C.categorize(inventory(spark, ROWS)))
    register_results(df, "given_result")
    counts = {r[0]: r[1] for r in spark.sql("SELECT * FROM given_result_categories").collect()}
    assert counts == {r[0]: r[1] for r in df.groupBy(CATEGORY_COL).count().collect()}
    assert spark.sql("SELECT sum(items) FROM given_result_crosstab").first()[0] == len(ROWS)


@pytest.mark.parametrize("small", (True, False))
def test_answers_on_stored_rows_equal_answers_in_one_go(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    df = inventory(spark, ROWS)
    stored = C.categorize(df, trace=True).checkpoint()
    reqs = L.pending(L.requests(stored, "category"))
    given = reqs.select("request_id", F.when(F.col("context").contains("zzz"), "Diagnostics & Lab Use").otherwise("no label").alias("response"))
    cat = C.apply_answers(stored, "category", given)
    assert sorted(map(str, cat.select("DESCRIPTION", CATEGORY_COL).collect())) == sorted(map(str, C.categorize(df, completions=given).select("DESCRIPTION", CATEGORY_COL).collect()))
    fac = C.facility(cat, trace=True).checkpoint()
    answers = L.pending(L.requests(fac, "facility")).select("request_id", F.lit("Both Settings").alias("response"))
    out = C.apply_answers(fac, "facility", answers)
    want = C.facility(C.categorize(df, completions=given), completions=answers)
    cols = ["DESCRIPTION", CATEGORY_COL, FACILITY_COL]
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    again = C.apply_answers(out, "facility", answers)  # as often as one likes
    assert again.columns == out.columns and again.count() == len(ROWS)

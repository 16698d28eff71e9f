"""Registered queries of results that merge (profiles, samples) and of the SQL functions and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import any_match_sql
from ..functions.sqlfunctions import register_functions, register_results
from ..functions.vocab import CATEGORY_COL, DISTRICT_KEYWORDS, FACILITY_COL, REVIEW_KEYWORDS, RURAL_KEYWORDS
from ..operators import classify as C
from ..operators import enrich as L
from ..operators import report as R
from ..session import work_path
from ..sinks.store import AnswerStore
from ..sources import inventory as S
from ..sources.testview import lineitem_inventory, part_inventory
from . import sqlforms as Q
from . import fixtures as X
from .catalog import LI, PI, SAMPLE_SEED, _inv, _pinv, _q_categories_applied, register

SLICES = 4
#: Stated error of a merged distinct count.
DISTINCT_ERROR = 0.05


def _q_profile():
    q = Q.Sql()
    _inv(q)
    cols = ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "CATEGORY", "SUBCATEGORY"]
    return q.query(" UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS rows, count({c}) AS non_null, true AS distinct_close FROM {LI}" for c in cols))


@register("profile_merged", _q_profile())
def profile_merged(spark, d):
    """S5 over four files: each stores its sketches, the states are united without reading a row again."""
    base = work_path(spark, "profile")
    inv = lineitem_inventory(spark, d).select("ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "CATEGORY", "SUBCATEGORY")
    for i in range(SLICES):
        S.profile_state(inv.where(F.pmod(F.length("ITEM_NO"), F.lit(SLICES)) == i)).write.parquet(f"{base}/slice={i}")
    merged = S.merged_profile(spark.read.parquet(base))
    exact = S.profile(inv).select("column", F.col("distinct_values").alias("exact"))
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= DISTINCT_ERROR * F.col("exact") + 1
    return merged.join(exact, "column").select("column", "rows", "non_null", close.alias("distinct_close"))


def _q_sample_merged():
    q = Q.Sql()
    _pinv(q)
    return q.query(f"SELECT KEY, DESCRIPTION FROM {PI} ORDER BY md5('{SAMPLE_SEED}' || CAST(KEY AS VARCHAR)), KEY LIMIT 10")


@register("sample_merged", _q_sample_merged())
def sample_merged(spark, d):
    """G3 over four files: each keeps its own first rows by hash; together they give the sample of all rows."""
    base, inv = work_path(spark, "samples"), part_inventory(spark, d).select("KEY", "DESCRIPTION")
    for i in range(SLICES):
        R.sample_state(inv.where(F.pmod(F.xxhash64("KEY"), F.lit(SLICES)) == i), "KEY", SAMPLE_SEED, 10).write.parquet(f"{base}/slice={i}")
    return R.merged_sample(spark.read.parquet(base), "KEY", 10).select("KEY", "DESCRIPTION")


def _q_sql_functions():
    q = Q.Sql()
    _inv(q)
    lab = Q.category_label(q, Q.category_trace(q, LI))
    flags = ", ".join(f"{any_match_sql('lower(DESCRIPTION)', words)} AS {name}" for name, words in (("review", REVIEW_KEYWORDS), ("rural", RURAL_KEYWORDS), ("district", DISTRICT_KEYWORDS)))
    return q.query(f"SELECT ITEM_NO, DESCRIPTION, {Q.PC}, {flags} FROM {lab}")


@register("sql_functions", _q_sql_functions())
def sql_functions(spark, d):
    """C3 and C5 in SQL alone: a scalar and a table-valued function over the inventory view."""
    register_functions(spark)
    lineitem_inventory(spark, d).createOrReplaceTempView("inventory_given")
    return spark.sql(
        f"SELECT ITEM_NO, DESCRIPTION, product_category(DESCRIPTION, SUBCATEGORY) AS `{CATEGORY_COL}`, f.review, f.rural, f.district "
        "FROM inventory_given, LATERAL facility_flags(DESCRIPTION) f"
    )


def _q_sql_views():
    q = Q.Sql()
    _inv(q)
    ft = Q.facility_trace(q, Q.category_label(q, Q.category_trace(q, LI)))
    fl = Q.facility_label(q, ft)
    return q.query(f"SELECT {Q.PC}, {Q.FS}, count(*) AS items FROM {fl} GROUP BY 1, 2")


@register("sql_views", _q_sql_views())
def sql_views(spark, d):
    """A3 in SQL alone, from the views of a classified table."""
    path = work_path(spark, "classified")
    C.facility(C.categorize(lineitem_inventory(spark, d))).write.parquet(path)
    register_results(spark.read.parquet(path), "inventory_classified")
    return spark.sql(f"SELECT `{CATEGORY_COL}`, `{FACILITY_COL}`, items FROM inventory_classified_crosstab")


@register("answer_store", _q_categories_applied())
def answer_store(spark, d):
    """K2/L3: answers of ten batches, older ones corrected by later, in a bucketed store that merges as it grows."""
    traced = C.categorize(lineitem_inventory(spark, d), trace=True).drop("_match").checkpoint()
    reqs = L.requests(traced, "category")
    right, wrong = (X.scripted_completions(reqs, a).checkpoint() for a in (X.ANSWERS, X.ANSWERS[::-1]))
    part = F.pmod(F.xxhash64("request_id"), F.lit(5))
    store = AnswerStore(spark, work_path(spark, "answer-store"), buckets=16, merge_after=4)
    for i in range(5):
        store.append(wrong.where(part == i), i)
    for i in range(5):
        store.append(right.where(part == i), 5 + i)
    return C.apply_answers(traced, "category", store).select("ITEM_NO", "DESCRIPTION", CATEGORY_COL)

"""Registered queries: one per operator of the coverage list, each with a
Spark builder ``(spark, sf_dir) -> DataFrame`` and, where SQL can express it,
the same computation in DuckDB SQL over the driver tables.

Every query reads the driver tables (or tables Spark derives from them) in
full; answers and attempt logs are derived from the requests themselves
(see :mod:`kindsort.plans.fixtures`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rulejoin import first_match_by_table
from ..functions.rules import rules_table
from ..functions.text import null_tokens_sql, sql_str
from ..functions.vocab import (
    CATEGORY_COL,
    CATEGORY_RULES,
    EXPECTED_COLUMNS,
    FACILITY_COL,
    FACILITY_LABELS,
    CATEGORY_LABELS,
    REQUIRED_COLUMNS,
    SIMPLE_DESC_COL,
    distinct_in_order,
)
from ..operators import classify as C
from ..operators import enrich as L
from ..operators import report as R
from ..session import compiled, let_go, noted, released, stored
from ..sources import inventory as S
from ..sources.testview import (
    LINEITEM_INVENTORY_SQL,
    PART_INVENTORY_SQL,
    DOCUMENT_INVENTORY_SQL,
    document_inventory,
    lineitem_inventory,
    part_inventory,
)
from . import fixtures as X
from . import sqlforms as Q
from .batch import CLI_DEFAULTS, FORM_DEFAULTS, Options, build, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------------------
# parameters of the registered queries (ours)
# ---------------------------------------------------------------------------

# example vocabulary for the electricity rule (none ships with the reproduced rules)
ELECTRICITY_WORDS = ["monitor", "pump", "concentrator", "printer", "analyzer", "x-ray", "autoclave", "light"]

# example component rules for the "needs other parts" flag: (keyword, component)
COMPONENT_RULES = [
    ("syringe pump", "syringes"),
    ("infusion pump", "tubing set"),
    ("concentrator", "tubing set"),
    ("nebulizer", "tubing set"),
    ("glucometer", "test strips"),
    ("blood pressure monitor", "cuff"),
    ("printer", "paper roll"),
    ("ecg", "paper roll"),
    ("syringe", "needle"),
    ("monitor", "power supply"),
    ("analyzer", "power supply"),
    ("pump", "power supply"),
    ("thermometer", "batteries"),
    ("otoscope", "batteries"),
    ("pulse oximeter", "batteries"),
    ("portable", "batteries"),
]
DESCRIPTION_SUBSET = 500
BATCH_SIZE = 50
SAMPLE_SEED = 42

LI, PI, DI = "inv", "pinv", "dinv"


def _matched(df: DataFrame) -> DataFrame:
    """The inventory with its vocabularies matched, written once.

    Queries that derive answers from their own requests read the rows in
    several branches; the written rows (shared work folder) let
    every branch reuse one matching pass and survives executor loss."""
    # the flag columns are already extracted: do not store the struct twice
    return stored(C.with_matches(df).drop("_match"), "matched")


def _inv(q: Q.Sql) -> str:
    return q.add(LI, LINEITEM_INVENTORY_SQL)


def _pinv(q: Q.Sql, with_row: bool = False) -> str:
    q.add(PI, PART_INVENTORY_SQL)
    if with_row:
        return q.add("pinv_r", f"SELECT *, row_number() OVER (ORDER BY KEY) - 1 AS _row FROM {PI}")
    return PI


# ===========================================================================
# S: sources and checks
# ===========================================================================

def _q_inventory_view():
    q = Q.Sql()
    _inv(q)
    return q.query(f"SELECT * FROM {LI}")


@register("inventory_view", _q_inventory_view())
def inventory_view(spark, d):
    return lineitem_inventory(spark, d)


def _q_null_tokens():
    q = Q.Sql()
    _inv(q)
    cols = ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "CATEGORY", "SUBCATEGORY"]
    sel = ", ".join(f"{null_tokens_sql(c)} AS {c}" for c in cols)
    return q.query(f"SELECT {sel}, AVAILABILITY_QTY, COST, EXT_COST FROM {LI}")


@register("null_tokens", _q_null_tokens())
def null_tokens(spark, d):
    return S.normalize_nulls(lineitem_inventory(spark, d))


def _inv_cols():
    return ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "CATEGORY", "SUBCATEGORY", "AVAILABILITY_QTY", "COST", "EXT_COST"]


def _q_schema_drift():
    q = Q.Sql()
    _inv(q)
    cols = _inv_cols()
    q.add("n", "SELECT " + ", ".join(f"count({c}) AS n_{c}" for c in cols) + f" FROM {LI}")
    rows = []
    for i, c in enumerate(EXPECTED_COLUMNS):
        if c in cols:
            rows.append(f"SELECT '{c}' AS column_name, {i + 1} AS position, 'present' AS status, n_{c} AS non_null FROM n")
        else:
            rows.append(f"SELECT '{c}' AS column_name, {i + 1} AS position, 'missing' AS status, CAST(NULL AS BIGINT) AS non_null FROM n")
    extra = [c for c in cols if c not in EXPECTED_COLUMNS]
    for j, c in enumerate(extra):
        rows.append(f"SELECT '{c}', {len(EXPECTED_COLUMNS) + j + 1}, 'extra', n_{c} FROM n")
    return q.query(" UNION ALL ".join(rows))


@register("schema_drift", _q_schema_drift())
def schema_drift(spark, d):
    return S.schema_drift(lineitem_inventory(spark, d)).withColumnRenamed("column", "column_name")


def _q_required_columns():
    q = Q.Sql()
    _inv(q)
    rows = [
        f"SELECT '{c}' AS column_name, true AS present, count(*) FILTER (WHERE {c} IS NULL OR {c} = '') AS blank_rows FROM {LI}"
        for c in REQUIRED_COLUMNS
    ]
    return q.query(" UNION ALL ".join(rows))


@register("required_columns", _q_required_columns())
def required_columns(spark, d):
    df = lineitem_inventory(spark, d)
    S.check_required(df)
    return S.required_columns_table(df).withColumnRenamed("column", "column_name")


def _q_table_profile():
    q = Q.Sql()
    _inv(q)
    rows = [
        f"SELECT '{c}' AS column_name, {i + 1} AS position, count(*) AS n_rows, count({c}) AS non_null, "
        f"count(DISTINCT {c}) AS distinct_values FROM {LI}"
        for i, c in enumerate(_inv_cols())
    ]
    return q.query(" UNION ALL ".join(rows))


@register("table_profile", _q_table_profile())
def table_profile(spark, d):
    return S.profile(lineitem_inventory(spark, d)).withColumnRenamed("column", "column_name").withColumnRenamed(
        "rows", "n_rows"
    )


def _q_preview():
    q = Q.Sql()
    _pinv(q)
    return q.query(
        f"SELECT *, false AS has_category, false AS has_facility, false AS has_description FROM {PI} ORDER BY KEY LIMIT 5"
    )


@register("preview_first_5", _q_preview())
def preview_first_5(spark, d):
    return S.preview(part_inventory(spark, d), "KEY")


# ===========================================================================
# C: classifiers
# ===========================================================================

def _q_categorize_keyword():
    from ..functions.rules import first_match_keyword_sql, keyword_label_sql

    q = Q.Sql()
    _inv(q)
    q.add("k", f"SELECT ITEM_NO, DESCRIPTION, {first_match_keyword_sql('lower(DESCRIPTION)', CATEGORY_RULES)} AS keyword FROM {LI}")
    return q.query(f"SELECT *, {keyword_label_sql('keyword', CATEGORY_RULES)} AS label FROM k")


@register("categorize_keyword", _q_categorize_keyword())
def categorize_keyword(spark, d):
    return C.keyword_category(lineitem_inventory(spark, d)).select("ITEM_NO", "DESCRIPTION", "keyword", "label")


def _q_subcategory_hint():
    from ..functions.rules import keyword_label_sql

    q = Q.Sql()
    _inv(q)
    t = Q.category_trace(q, LI)
    return q.query(
        f"SELECT ITEM_NO, SUBCATEGORY, _cat_subkw AS keyword, {keyword_label_sql('_cat_subkw', CATEGORY_RULES)} AS label "
        f"FROM {t} WHERE _cat_kw IS NULL AND (SUBCATEGORY IS NOT NULL AND SUBCATEGORY <> '')"
    )


@register("categorize_subcategory_hint", _q_subcategory_hint())
def categorize_subcategory_hint(spark, d):
    from ..functions.rules import keyword_label

    t = C.categorize(lineitem_inventory(spark, d), trace=True)
    t = t.filter(F.col("_cat_kw").isNull() & t.SUBCATEGORY.isNotNull() & (t.SUBCATEGORY != ""))
    return t.select(
        "ITEM_NO", "SUBCATEGORY", F.col("_cat_subkw").alias("keyword"), keyword_label(F.col("_cat_subkw"), CATEGORY_RULES).alias("label")
    )


def _q_product_category():
    q = Q.Sql()
    _inv(q)
    t = Q.category_trace(q, LI)
    lab = Q.category_label(q, t)
    return q.query(f"SELECT ITEM_NO, DESCRIPTION, VENDOR_NAME, SUBCATEGORY, {Q.PC} FROM {lab}")


@register("product_category", _q_product_category())
def product_category(spark, d):
    return C.categorize(lineitem_inventory(spark, d)).select("ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "SUBCATEGORY", CATEGORY_COL)


def _q_category_trace():
    q = Q.Sql()
    _inv(q)
    t = Q.category_trace(q, LI)
    return q.query(
        f"SELECT ITEM_NO, _cat_src AS category_source, "
        f"CASE _cat_src WHEN 'description' THEN _cat_kw WHEN 'subcategory' THEN _cat_subkw END AS category_keyword, "
        f"_cat_rid AS category_request_id FROM {t}"
    )


@register("category_trace", _q_category_trace())
def category_trace(spark, d):
    t = C.categorize(lineitem_inventory(spark, d), trace=True)
    return t.select(
        "ITEM_NO",
        F.col("_cat_src").alias("category_source"),
        F.when(F.col("_cat_src") == "description", F.col("_cat_kw"))
        .when(F.col("_cat_src") == "subcategory", F.col("_cat_subkw"))
        .alias("category_keyword"),
        F.col("_cat_rid").alias("category_request_id"),
    )


EXISTING_SQL = (
    "CASE length(ITEM_NO) % 7 WHEN 0 THEN 'Custom Supplies' WHEN 1 THEN ' ' WHEN 2 THEN '' "
    "WHEN 3 THEN 'Diagnostics & Lab Use' ELSE NULL END"
)


def _with_existing(df: DataFrame) -> DataFrame:
    k = F.pmod(F.length("ITEM_NO"), F.lit(7))
    existing = (
        F.when(k == 0, F.lit("Custom Supplies"))
        .when(k == 1, F.lit(" "))
        .when(k == 2, F.lit(""))
        .when(k == 3, F.lit("Diagnostics & Lab Use"))
    )
    return df.withColumn(CATEGORY_COL, existing)


def _q_preserve_existing():
    q = Q.Sql()
    _inv(q)
    q.add("ex", f"SELECT *, {EXISTING_SQL} AS {Q.PC} FROM {LI}")
    t = Q.category_trace(q, "ex", existing=Q.PC)
    q.add("ex2", f"SELECT *, {Q.PC} AS existing_category FROM {t}")
    lab = Q.category_label(q, "ex2", existing="existing_category", replace=True)
    return q.query(f"SELECT ITEM_NO, existing_category, _cat_src AS category_source, {Q.PC} FROM {lab}")


@register("preserve_existing", _q_preserve_existing())
def preserve_existing(spark, d):
    df = _with_existing(lineitem_inventory(spark, d)).withColumn("existing_category", F.col(CATEGORY_COL))
    t = C.categorize(df, preserve_existing=True, trace=True)
    return t.select("ITEM_NO", "existing_category", F.col("_cat_src").alias("category_source"), CATEGORY_COL)


def _q_facility():
    q = Q.Sql()
    _inv(q)
    t = Q.category_trace(q, LI)
    lab = Q.category_label(q, t)
    ft = Q.facility_trace(q, lab)
    fl = Q.facility_label(q, ft)
    return q.query(f"SELECT ITEM_NO, DESCRIPTION, {Q.PC}, {Q.FS} FROM {fl}")


@register("facility_suitability", _q_facility())
def facility_suitability(spark, d):
    # trace=True keeps the match columns, so facility reuses the one matching pass
    cat = C.categorize(lineitem_inventory(spark, d), trace=True)
    return C.facility(cat).select("ITEM_NO", "DESCRIPTION", CATEGORY_COL, FACILITY_COL)


def _q_facility_flags():
    q = Q.Sql()
    _inv(q)
    q.add("invc", f"SELECT *, CAST(NULL AS VARCHAR) AS {Q.PC} FROM {LI}")
    ft = Q.facility_trace(q, "invc")
    return q.query(f"SELECT ITEM_NO, _fac_review AS review, _fac_rural AS rural, _fac_district AS district FROM {ft}")


@register("facility_flags", _q_facility_flags())
def facility_flags(spark, d):
    f = C.facility_flags(lineitem_inventory(spark, d))
    return f.select(
        "ITEM_NO", F.col("_fac_review").alias("review"), F.col("_fac_rural").alias("rural"), F.col("_fac_district").alias("district")
    )


def _q_electricity():
    q = Q.Sql()
    _inv(q)
    t = Q.category_trace(q, LI)
    lab = Q.category_label(q, t)
    et = Q.electricity_trace(q, lab, ELECTRICITY_WORDS)
    q.add("ereq", Q.requests_sql(et, "electricity", "_ele"))
    q.add("ecomp", X.scripted_completions_sql("SELECT * FROM ereq", X.YES_NO_ANSWERS))
    ans = Q.yes_no_answers(q, "eans", "ecomp")
    el = Q.electricity_label(q, et, ans)
    return q.query(f'SELECT ITEM_NO, _ele_src AS electricity_source, "Requires Electricity" FROM {el}')


@register("electricity_usage", _q_electricity())
def electricity_usage(spark, d):
    cat = C.categorize(_matched(lineitem_inventory(spark, d)))
    traced = C.electricity(cat, ELECTRICITY_WORDS, trace=True)
    comp = X.scripted_completions(L.requests(traced, "electricity"), X.YES_NO_ANSWERS)
    out = C.electricity(cat, ELECTRICITY_WORDS, completions=comp, trace=True)
    return out.select("ITEM_NO", F.col("_ele_src").alias("electricity_source"), C.ELECTRICITY_COL)


# ===========================================================================
# Answer normalisation
# ===========================================================================

def _cat_requests_sql(q: Q.Sql) -> str:
    _inv(q)
    t = Q.category_trace(q, LI)
    return q.add("creq", Q.requests_sql(t, "category", "_cat"))


def _cat_requests(spark, d) -> DataFrame:
    return L.requests(C.categorize(lineitem_inventory(spark, d), trace=True), "category")


def _q_norm_category():
    q = Q.Sql()
    _cat_requests_sql(q)
    q.add("ccomp", X.scripted_completions_sql("SELECT * FROM creq", all_answered=True))
    ans = Q.label_answers(q, "cans", "ccomp", CATEGORY_LABELS)
    return q.query(f"SELECT c.request_id, c.response, a.ans AS normalized FROM ccomp c JOIN {ans} a ON c.request_id = a.request_id")


@register("normalize_category_answer", _q_norm_category())
def normalize_category_answer(spark, d):
    from ..functions.text import normalize_label

    comp = X.scripted_completions(_cat_requests(spark, d), all_answered=True)
    return comp.select("request_id", "response", normalize_label(F.col("response"), CATEGORY_LABELS).alias("normalized"))


def _fac_requests_sql(q: Q.Sql, with_answers: bool = True) -> str:
    _cat_requests_sql(q)
    q.add("ccomp", X.scripted_completions_sql("SELECT * FROM creq"))
    cans = Q.label_answers(q, "cans", "ccomp", CATEGORY_LABELS)
    lab = Q.category_label(q, "c4", cans)
    ft = Q.facility_trace(q, lab)
    return q.add("freq", Q.requests_sql(ft, "facility", "_fac"))


def _answered_categories(spark, d) -> DataFrame:
    traced = C.categorize(lineitem_inventory(spark, d), trace=True).drop("_match").checkpoint()
    return C.apply_answers(traced, "category", X.scripted_completions(L.requests(traced, "category")))


def _fac_requests(spark, d) -> DataFrame:
    return L.requests(C.facility(_answered_categories(spark, d), trace=True), "facility")


def _q_norm_facility():
    q = Q.Sql()
    _fac_requests_sql(q)
    q.add("fcomp", X.scripted_completions_sql("SELECT * FROM freq", all_answered=True))
    ans = Q.label_answers(q, "fans", "fcomp", FACILITY_LABELS)
    return q.query(f"SELECT c.request_id, c.response, a.ans AS normalized FROM fcomp c JOIN {ans} a ON c.request_id = a.request_id")


@register("normalize_facility_answer", _q_norm_facility())
def normalize_facility_answer(spark, d):
    from ..functions.text import normalize_label

    comp = X.scripted_completions(_fac_requests(spark, d), all_answered=True)
    return comp.select("request_id", "response", normalize_label(F.col("response"), FACILITY_LABELS).alias("normalized"))


def _q_norm_yes_no():
    q = Q.Sql()
    _inv(q)
    t = Q.category_trace(q, LI)
    lab = Q.category_label(q, t)
    et = Q.electricity_trace(q, lab, ELECTRICITY_WORDS)
    q.add("ereq", Q.requests_sql(et, "electricity", "_ele"))
    q.add("ecomp", X.scripted_completions_sql("SELECT * FROM ereq", X.YES_NO_ANSWERS, all_answered=True))
    ans = Q.yes_no_answers(q, "eans", "ecomp")
    return q.query(f"SELECT c.request_id, c.response, a.ans AS normalized FROM ecomp c JOIN {ans} a ON c.request_id = a.request_id")


@register("normalize_yes_no", _q_norm_yes_no())
def normalize_yes_no(spark, d):
    from ..functions.text import normalize_yes_no as yn

    cat = C.categorize(lineitem_inventory(spark, d))
    comp = X.scripted_completions(L.requests(C.electricity(cat, ELECTRICITY_WORDS, trace=True), "electricity"), X.YES_NO_ANSWERS, all_answered=True)
    return comp.select("request_id", "response", yn(F.col("response")).alias("normalized"))


def _desc_requests_sql(q: Q.Sql, first_n: int | None = None) -> str:
    base = _pinv(q, with_row=bool(first_n))
    dt = Q.description_trace(q, base, first_n=first_n)
    q.add("dreq", Q.requests_sql(dt, "description", "_desc"))
    return dt


def _part_rows(spark, d) -> DataFrame:
    return L.with_row_index(part_inventory(spark, d), ["KEY"])


def _desc_requests(spark, d) -> DataFrame:
    return L.requests(C.describe(part_inventory(spark, d), trace=True), "description")


def _q_clean_description():
    from ..functions.text import clean_description_sql

    q = Q.Sql()
    _desc_requests_sql(q)
    q.add("att", X.scripted_attempts_sql("SELECT * FROM dreq", all_tried=True))
    return q.query(
        f"SELECT request_id, attempt, response, {clean_description_sql('response')} AS cleaned FROM att "
        "WHERE responded AND response IS NOT NULL"
    )


@register("clean_description", _q_clean_description())
def clean_description(spark, d):
    from ..functions.text import clean_description as cd

    att = X.scripted_attempts(_desc_requests(spark, d), all_tried=True)
    return att.filter(F.col("responded") & F.col("response").isNotNull()).select(
        "request_id", "attempt", "response", cd(F.col("response")).alias("cleaned")
    )


# ===========================================================================
# L: requests, answers, attempts
# ===========================================================================

def _q_req_category():
    q = Q.Sql()
    _cat_requests_sql(q)
    return q.query("SELECT * FROM creq")


@register("model_requests_category", _q_req_category())
def model_requests_category(spark, d):
    return _cat_requests(spark, d)


def _q_req_facility():
    q = Q.Sql()
    _fac_requests_sql(q)
    return q.query("SELECT * FROM freq")


@register("model_requests_facility", _q_req_facility())
def model_requests_facility(spark, d):
    return _fac_requests(spark, d)


def _q_req_description():
    q = Q.Sql()
    _desc_requests_sql(q)
    return q.query("SELECT * FROM dreq")


@register("model_requests_description", _q_req_description())
def model_requests_description(spark, d):
    return _desc_requests(spark, d)


def _q_pending():
    q = Q.Sql()
    _cat_requests_sql(q)
    q.add("ccomp", X.scripted_completions_sql("SELECT * FROM creq"))
    return q.query(
        "SELECT * FROM (SELECT DISTINCT * FROM creq) r WHERE NOT EXISTS (SELECT 1 FROM ccomp c WHERE c.request_id = r.request_id)"
    )


@register("pending_requests", _q_pending())
def pending_requests(spark, d):
    # the requests feed both sides of the anti-join: match the rows once
    reqs = L.requests(C.categorize(_matched(lineitem_inventory(spark, d)), trace=True), "category")
    done = X.scripted_completions(reqs)
    return L.pending(reqs, done)


def _q_apply():
    q = Q.Sql()
    freq = _fac_requests_sql(q)
    q.add("fcomp", X.scripted_completions_sql(f"SELECT * FROM {freq}"))
    fans = Q.label_answers(q, "fans", "fcomp", FACILITY_LABELS)
    fl = Q.facility_label(q, "f4", fans)
    return q.query(f"SELECT ITEM_NO, DESCRIPTION, {Q.PC}, {Q.FS} FROM {fl}")


def _applied(spark, d) -> DataFrame:
    traced = C.facility(_answered_categories(spark, d), trace=True).checkpoint()
    return C.apply_answers(traced, "facility", X.scripted_completions(L.requests(traced, "facility")))


@register("apply_completions", _q_apply())
def apply_completions(spark, d):
    return _applied(spark, d).select("ITEM_NO", "DESCRIPTION", CATEGORY_COL, FACILITY_COL)


def _q_resolve():
    q = Q.Sql()
    _desc_requests_sql(q)
    q.add("att", X.scripted_attempts_sql("SELECT * FROM dreq", all_tried=True))
    r = Q.resolve_attempts_sql(q, "att")
    return q.query(f"SELECT * FROM {r}")


def _resolved(spark, d) -> DataFrame:
    return L.resolve_attempts(X.scripted_attempts(_desc_requests(spark, d), all_tried=True))


@register("resolve_attempts", _q_resolve())
def resolve_attempts(spark, d):
    return _resolved(spark, d)


def _q_usage():
    q = Q.Sql()
    _desc_requests_sql(q)
    q.add("att", X.scripted_attempts_sql("SELECT * FROM dreq", all_tried=True))
    r = Q.resolve_attempts_sql(q, "att")
    return q.query(
        f"SELECT CAST(coalesce(sum(responses), 0) AS BIGINT) AS total_requests, "
        f"CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, "
        f"{Q.cost_expr('CAST(coalesce(sum(tokens), 0) AS BIGINT)')} AS est_cost FROM {r}"
    )


@register("usage_cost", _q_usage())
def usage_cost(spark, d):
    return L.usage(_resolved(spark, d))


PRIOR_SQL = "CASE WHEN KEY % 3 = 0 THEN 'prior ' || ITEM_NO END"


def _q_description_subset():
    q = Q.Sql()
    _pinv(q, with_row=True)
    q.add("pr", f"SELECT *, {PRIOR_SQL} AS SIMPLE_DESCRIPTION FROM pinv_r")
    dt = Q.description_trace(q, "pr", first_n=DESCRIPTION_SUBSET)
    q.add("dreq", Q.requests_sql(dt, "description", "_desc"))
    q.add("att", X.scripted_attempts_sql("SELECT * FROM dreq"))
    r = Q.resolve_attempts_sql(q, "att")
    lab = Q.description_label(q, dt, r, prior="SIMPLE_DESCRIPTION")
    return q.query(
        f"SELECT KEY, CASE WHEN _row < {DESCRIPTION_SUBSET} THEN _row END AS _row, _desc_src AS description_source, SIMPLE_DESCRIPTION FROM {lab}"
    )


@register("description_subset", _q_description_subset())
def description_subset(spark, d):
    base = L.first_rows(part_inventory(spark, d), ["KEY"], DESCRIPTION_SUBSET).withColumn(
        SIMPLE_DESC_COL, F.when(F.pmod(F.col("KEY"), F.lit(3)) == 0, F.concat(F.lit("prior "), F.col("ITEM_NO")))
    )
    reqs = L.requests(C.describe(base, first_n=DESCRIPTION_SUBSET, trace=True), "description")
    resolved = L.resolve_attempts(X.scripted_attempts(reqs))
    out = C.describe(base, resolved, first_n=DESCRIPTION_SUBSET, trace=True)
    return out.select("KEY", "_row", F.col("_desc_src").alias("description_source"), SIMPLE_DESC_COL)


def _q_batches():
    q = Q.Sql()
    base = _pinv(q, with_row=True)
    t = Q.category_trace(q, base)
    return q.query(
        f"SELECT CAST(_row // {BATCH_SIZE} AS BIGINT) AS batch_id, count(*) AS n_rows, "
        f"count(*) FILTER (WHERE _cat_src = 'residual') AS n_requests, min(KEY) AS first_key, max(KEY) AS last_key "
        f"FROM {t} GROUP BY 1"
    )


@register("request_batches", _q_batches())
def request_batches(spark, d):
    t = C.categorize(_part_rows(spark, d), trace=True)
    return t.groupBy(L.batch_of(F.col("_row"), BATCH_SIZE).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_cat_src") == "residual").alias("n_requests"),
        F.min("KEY").alias("first_key"),
        F.max("KEY").alias("last_key"),
    )


def _q_completer():
    q = Q.Sql()
    _cat_requests_sql(q)
    n = len(X.ANSWERS)
    arr = "[" + ", ".join(sql_str(a) for a in X.ANSWERS) + "]"
    return q.query(f"SELECT DISTINCT request_id, ({arr})[CAST(length(context) % {n} AS BIGINT) + 1] AS response FROM creq")


@register("completer_hook", _q_completer())
def completer_hook(spark, d):
    return L.complete_with(_cat_requests(spark, d), X.scripted_answer, partitions=8)


# ===========================================================================
# A, G, K: reports
# ===========================================================================

def _classified_sql(q: Q.Sql) -> str:
    _inv(q)
    t = Q.category_trace(q, LI)
    lab = Q.category_label(q, t)
    ft = Q.facility_trace(q, lab)
    return Q.facility_label(q, ft)


def _classified(spark, d) -> DataFrame:
    return C.facility(C.categorize(lineitem_inventory(spark, d), trace=True), trace=True)


def _q_dist(col: str):
    q = Q.Sql()
    fl = _classified_sql(q)
    q.add("g", f"SELECT {col} AS label, count(*) AS items FROM {fl} GROUP BY 1")
    q.add("t", "SELECT sum(items) AS total FROM g")
    return q.query(f"SELECT label, items, {Q.percent_expr('items', 'total')} AS pct FROM g, t WHERE label IS NOT NULL")


@register("category_distribution", _q_dist(Q.PC))
def category_distribution(spark, d):
    return R.distribution(_classified(spark, d), CATEGORY_COL).withColumnRenamed("count", "items")


@register("facility_distribution", _q_dist(Q.FS))
def facility_distribution(spark, d):
    return R.distribution(_classified(spark, d), FACILITY_COL).withColumnRenamed("count", "items")


def _q_crosstab():
    q = Q.Sql()
    fl = _classified_sql(q)
    cells = ", ".join(f"count(*) FILTER (WHERE {Q.FS} = {sql_str(v)}) AS \"{v}\"" for v in FACILITY_LABELS)
    return q.query(
        f"SELECT {Q.PC} AS label, {cells} FROM {fl} WHERE {Q.PC} IS NOT NULL AND {Q.FS} IS NOT NULL GROUP BY 1"
    )


@register("category_facility_crosstab", _q_crosstab())
def category_facility_crosstab(spark, d):
    return R.crosstab(_classified(spark, d))


def _q_global_counts():
    q = Q.Sql()
    _inv(q)
    q.add("ex", f"SELECT *, {EXISTING_SQL} AS {Q.PC} FROM {LI}")
    t = Q.category_trace(q, "ex", existing=Q.PC)
    lab = Q.category_label(q, t, existing=Q.PC, replace=True)
    ft = Q.facility_trace(q, lab)
    return q.query(
        f"SELECT count(*) AS total_rows, count({Q.PC}) AS category_not_null, "
        f"count(*) FILTER (WHERE {Q.PC} IS NULL OR {Q.PC} = '') AS category_blank, "
        f"count(*) FILTER (WHERE DESCRIPTION IS NULL OR DESCRIPTION = '') AS description_blank, "
        f"count(*) FILTER (WHERE _cat_src = 'preserved') AS category_preserved, "
        f"count(*) FILTER (WHERE _cat_src = 'residual') AS category_residual, "
        f"count(*) FILTER (WHERE _fac_src = 'residual') AS facility_residual FROM {ft}"
    )


@register("global_counts", _q_global_counts())
def global_counts(spark, d):
    df = _with_existing(lineitem_inventory(spark, d))
    t = C.facility(C.categorize(df, preserve_existing=True, trace=True), trace=True)
    return R.global_counts(t)


def _q_distinct_labels():
    q = Q.Sql()
    freq = _fac_requests_sql(q)
    q.add("fcomp", X.scripted_completions_sql(f"SELECT * FROM {freq}"))
    fans = Q.label_answers(q, "fans", "fcomp", FACILITY_LABELS)
    fl = Q.facility_label(q, "f4", fans)
    return q.query(f"SELECT count(DISTINCT {Q.PC}) AS categories, count(DISTINCT {Q.FS}) AS facility_types FROM {fl}")


@register("distinct_labels", _q_distinct_labels())
def distinct_labels(spark, d):
    return R.distinct_labels(_applied(spark, d))


def _q_stage_progress():
    q = Q.Sql()
    fl = _classified_sql(q)
    return q.query(
        f"SELECT 'category' AS stage, _cat_src AS source, count(*) AS n_rows FROM {fl} GROUP BY 2 "
        f"UNION ALL SELECT 'facility', _fac_src, count(*) FROM {fl} GROUP BY 2"
    )


@register("stage_progress", _q_stage_progress())
def stage_progress(spark, d):
    return R.stage_progress(_classified(spark, d)).withColumnRenamed("rows", "n_rows")


# --- pipelines on the unique-key layout (sample and report need a key) ---------------------

def _part_pipeline_sql(q: Q.Sql) -> str:
    return _pipeline_sql(q, _pinv(q))


def _pipeline_sql(q: Q.Sql, base: str) -> str:
    """W1 with every stage: category, facility, description."""
    t = Q.category_trace(q, base)
    q.add("creq", Q.requests_sql(t, "category", "_cat"))
    q.add("ccomp", X.scripted_completions_sql("SELECT * FROM creq"))
    cans = Q.label_answers(q, "cans", "ccomp", CATEGORY_LABELS)
    lab = Q.category_label(q, t, cans)
    ft = Q.facility_trace(q, lab)
    q.add("freq", Q.requests_sql(ft, "facility", "_fac"))
    q.add("fcomp", X.scripted_completions_sql("SELECT * FROM freq"))
    fans = Q.label_answers(q, "fans", "fcomp", FACILITY_LABELS)
    fl = Q.facility_label(q, ft, fans)
    dt = Q.description_trace(q, fl)
    q.add("dreq", Q.requests_sql(dt, "description", "_desc"))
    q.add("att", X.scripted_attempts_sql("SELECT * FROM dreq"))
    r = Q.resolve_attempts_sql(q, "att")
    return Q.description_label(q, dt, r)


def _answers_for(df: DataFrame, opts: Options) -> tuple[DataFrame, DataFrame | None]:
    """Scripted answers for every request a run of ``opts`` sends, stage by stage."""
    with noted() as made:
        cat_t = stored(C.categorize(df, opts.preserve_existing, trace=True), "traced")
        comp = stored(X.scripted_completions(L.requests(cat_t, "category")), "completions")
        attempts = None
        if not opts.skip_facility:
            fac_t = C.facility(C.apply_answers(cat_t, "category", comp), trace=True)
            comp = comp.unionByName(stored(X.scripted_completions(L.requests(fac_t, "facility")), "completions"))
    let_go(df.sparkSession, made, comp)
    if not opts.skip_descriptions:
        desc_t = C.describe(df, trace=True)
        attempts = X.scripted_attempts(L.requests(desc_t, "description"))
    return comp, attempts


def _part_pipeline(spark, d) -> DataFrame:
    df = _matched(part_inventory(spark, d))
    comp, attempts = _answers_for(df, CLI_DEFAULTS)
    return build(df, CLI_DEFAULTS, comp, attempts)


def _q_summary():
    q = Q.Sql()
    res = _part_pipeline_sql(q)
    q.add("tot", f"SELECT count(*) AS n FROM {res}")

    def dist(col: str, section: int, name: str) -> str:
        q.add(f"{name}g", f"SELECT {col} AS label, count(*) AS items FROM {res} GROUP BY 1")
        q.add(f"{name}t", f"SELECT sum(items) AS total FROM {name}g")
        return (
            f"SELECT {section} AS section, items AS sort_count, label AS sort_label, "
            f"label || ': ' || CAST(items AS VARCHAR) || ' (' || printf('%.1f', {Q.percent_expr('items', 'total')}) || '%)' AS line "
            f"FROM {name}g, {name}t WHERE label IS NOT NULL"
        )

    parts = [f"SELECT 0 AS section, CAST(0 AS BIGINT) AS sort_count, '' AS sort_label, 'Total items processed: ' || CAST(n AS VARCHAR) AS line FROM tot"]
    parts.append(dist(Q.PC, 1, "cd"))
    parts.append(dist(Q.FS, 2, "fd"))
    cells = ", ".join(f"count(*) FILTER (WHERE {Q.FS} = {sql_str(v)}) AS \"c{i}\"" for i, v in enumerate(FACILITY_LABELS))
    q.add("ct", f"SELECT {Q.PC} AS label, {cells} FROM {res} WHERE {Q.PC} IS NOT NULL AND {Q.FS} IS NOT NULL GROUP BY 1")
    line = " || ', ' || ".join(f"{sql_str(v + '=')} || CAST(c{i} AS VARCHAR)" for i, v in enumerate(FACILITY_LABELS))
    parts.append(f"SELECT 3, CAST(0 AS BIGINT), label, label || ': ' || {line} FROM ct")
    h = f"md5('{SAMPLE_SEED}' || CAST(KEY AS VARCHAR))"
    q.add("smp", f"SELECT * FROM {res} ORDER BY {h}, KEY LIMIT 10")
    parts.append(
        f"SELECT 4, CAST(0 AS BIGINT), {h}, 'Original: ' || coalesce(DESCRIPTION, 'nan') || chr(10) || 'Simple  : ' || "
        f"coalesce(SIMPLE_DESCRIPTION, 'nan') FROM smp"
    )
    return q.query(" UNION ALL ".join(parts))


@register("summary_report", _q_summary())
def summary_report(spark, d):
    # the report reads the finished result in several branches: write it once
    # (as the batch pipeline does before reporting)
    result = _part_pipeline(spark, d).checkpoint(eager=True)
    return R.summary_report(result, "KEY", seed=SAMPLE_SEED)


def _q_sample():
    q = Q.Sql()
    res = _part_pipeline_sql(q)
    h = f"md5('{SAMPLE_SEED}' || CAST(KEY AS VARCHAR))"
    return q.query(f"SELECT KEY, DESCRIPTION, SIMPLE_DESCRIPTION FROM {res} ORDER BY {h}, KEY LIMIT 10")


@register("sample_descriptions", _q_sample())
def sample_descriptions(spark, d):
    return R.sample(_part_pipeline(spark, d), "KEY", SAMPLE_SEED).select("KEY", "DESCRIPTION", SIMPLE_DESC_COL)


def _q_batch_run_full():
    q = Q.Sql()
    res = _part_pipeline_sql(q)
    return q.query(f"SELECT KEY, ITEM_NO, DESCRIPTION, VENDOR_NAME, CATEGORY, SUBCATEGORY, COST, {Q.PC}, {Q.FS}, SIMPLE_DESCRIPTION FROM {res}")


@register("batch_run_full", _q_batch_run_full())
def batch_run_full(spark, d):
    return _part_pipeline(spark, d)


def _q_pipeline_skip():
    q = Q.Sql()
    _inv(q)
    t = Q.category_trace(q, LI)
    q.add("creq", Q.requests_sql(t, "category", "_cat"))
    q.add("ccomp", X.scripted_completions_sql("SELECT * FROM creq"))
    cans = Q.label_answers(q, "cans", "ccomp", CATEGORY_LABELS)
    lab = Q.category_label(q, t, cans)
    return q.query(
        f"SELECT ITEM_NO, DESCRIPTION, VENDOR_NAME, CATEGORY, SUBCATEGORY, AVAILABILITY_QTY, COST, EXT_COST, {Q.PC} FROM {lab}"
    )


@register("batch_run_form_defaults", _q_pipeline_skip())
def batch_run_form_defaults(spark, d):
    df = _matched(lineitem_inventory(spark, d))
    comp, attempts = _answers_for(df, FORM_DEFAULTS)
    return build(df, FORM_DEFAULTS, comp, attempts)


# ===========================================================================
# rule table form, component flags, documents
# ===========================================================================

def _q_rules_table():
    q = Q.Sql()
    _pinv(q)
    rules = " UNION ALL ".join(
        f"SELECT {i} AS priority, {sql_str(kw)} AS keyword, {sql_str(lab)} AS label" for i, (kw, lab) in enumerate(CATEGORY_RULES)
    )
    q.add("rules", rules)
    q.add("hits", f"SELECT p.KEY, r.priority, r.keyword, r.label FROM {PI} p LEFT JOIN rules r ON contains(lower(p.DESCRIPTION), r.keyword)")
    q.add("best", "SELECT KEY, min(priority) AS priority FROM hits GROUP BY KEY")
    return q.query(
        "SELECT b.KEY, b.priority, h.keyword, h.label FROM best b LEFT JOIN hits h ON b.KEY = h.KEY AND b.priority = h.priority"
    )


@register("rules_broadcast_join", _q_rules_table())
def rules_broadcast_join(spark, d):
    df = part_inventory(spark, d).withColumn("_d", F.lower("DESCRIPTION"))
    return first_match_by_table(df, "KEY", "_d", rules_table(spark), "category").select("KEY", "priority", "keyword", "label")


def _component_groups() -> list[tuple[str, list[str]]]:
    comps = sorted({c for _, c in COMPONENT_RULES})
    return [(c, distinct_in_order([k for k, cc in COMPONENT_RULES if cc == c])) for c in comps]


def _q_components():
    from ..functions.rules import any_match_sql

    q = Q.Sql()
    _pinv(q)
    parts = ", ".join(
        f"CASE WHEN {any_match_sql('lower(DESCRIPTION)', kws)} THEN {sql_str(c)} END" for c, kws in _component_groups()
    )
    return q.query(f"SELECT KEY, DESCRIPTION, nullif(concat_ws(', ', {parts}), '') AS components FROM {PI}")


@register("component_flags", _q_components())
def component_flags(spark, d):
    rules = spark.createDataFrame(COMPONENT_RULES, "keyword string, component string")
    return C.component_flags(part_inventory(spark, d), rules).select("KEY", "DESCRIPTION", "components")


def _q_doc_category():
    q = Q.Sql()
    q.add(DI, DOCUMENT_INVENTORY_SQL)
    q.add("dsub", f"SELECT *, CAST(NULL AS VARCHAR) AS SUBCATEGORY FROM {DI}")
    t = Q.category_trace(q, "dsub")
    lab = Q.category_label(q, t)
    return q.query(f"SELECT KEY, _cat_src AS category_source, _cat_kw AS category_keyword, {Q.PC} FROM {lab}")


@register("document_category", _q_doc_category())
def document_category(spark, d):
    t = C.categorize(document_inventory(spark, d), trace=True)
    return t.select("KEY", F.col("_cat_src").alias("category_source"), F.col("_cat_kw").alias("category_keyword"), CATEGORY_COL)


def _q_doc_facility():
    q = Q.Sql()
    q.add(DI, DOCUMENT_INVENTORY_SQL)
    q.add("dsub", f"SELECT *, CAST(NULL AS VARCHAR) AS SUBCATEGORY FROM {DI}")
    t = Q.category_trace(q, "dsub")
    lab = Q.category_label(q, t)
    ft = Q.facility_trace(q, lab)
    fl = Q.facility_label(q, ft)
    return q.query(f"SELECT KEY, _fac_src AS facility_source, {Q.FS} FROM {fl}")


@register("document_facility", _q_doc_facility())
def document_facility(spark, d):
    t = C.facility(C.categorize(document_inventory(spark, d), trace=True), trace=True)
    return t.select("KEY", F.col("_fac_src").alias("facility_source"), FACILITY_COL)


# ===========================================================================
# files and streams (written under the shared work folder)
# ===========================================================================

@register("csv_round_trip", _q_null_tokens())
def csv_round_trip(spark, d):
    from ..session import work_path
    from ..sinks import write_csv

    path = work_path(spark, "csv-round-trip")
    write_csv(lineitem_inventory(spark, d), path)
    back = S.read_inventory_csv(spark, path, measures=True)
    return back.select(*S.data_columns(back))


def _q_folder_stream():
    q = Q.Sql()
    _inv(q)
    q.add("nt", _q_null_tokens_body())
    t = Q.category_trace(q, "nt")
    lab = Q.category_label(q, t)
    ft = Q.facility_trace(q, lab)
    fl = Q.facility_label(q, ft)
    return q.query(f"SELECT {Q.PC}, {Q.FS}, count(*) AS n_rows FROM {fl} GROUP BY 1, 2")


def _q_null_tokens_body() -> str:
    cols = ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "CATEGORY", "SUBCATEGORY"]
    sel = ", ".join(f"{null_tokens_sql(c)} AS {c}" for c in cols)
    return f"SELECT {sel}, AVAILABILITY_QTY, COST, EXT_COST FROM {LI}"


@register("folder_stream", _q_folder_stream())
def folder_stream(spark, d):
    """The view lands as several CSV files; the stream of files classifies each."""
    from ..session import work_path
    from ..sinks import write_csv
    from ..streaming.folder import file_counts, run_folder

    landing = work_path(spark, "landing")
    out = work_path(spark, "stream-out")
    inv = lineitem_inventory(spark, d)
    write_csv(inv, landing)
    opts = Options(skip_facility=False, skip_descriptions=True)
    run_folder(spark, landing, out, work_path(spark, "stream-ckpt"), opts)
    counts = file_counts(spark, out)
    return counts.groupBy(CATEGORY_COL, FACILITY_COL).agg(F.sum("rows").cast("long").alias("n_rows"))


@register("run_record", "SELECT 'categorize' AS stage, count(*) AS rows FROM lineitem UNION ALL SELECT 'facility', count(*) FROM lineitem")
def run_record(spark, d):
    """K4: rows of each materialised stage (the stored record also has the seconds)."""
    from ..session import work_path
    from ..sinks import RunRecord, write_parquet

    rec = RunRecord(spark)
    inv = lineitem_inventory(spark, d)
    base = work_path(spark, "run-record")
    cat = C.categorize(inv)
    rec.timed("categorize", lambda: (write_parquet(cat, f"{base}/cat"), spark.read.parquet(f"{base}/cat").count())[1])
    fac = C.facility(spark.read.parquet(f"{base}/cat"))
    rec.timed("facility", lambda: (write_parquet(fac, f"{base}/fac"), spark.read.parquet(f"{base}/fac").count())[1])
    rec.append_to(f"{base}/record")
    return spark.read.parquet(f"{base}/record").select("stage", "rows")


# --- files as users have them --------------------------------------------------------------

RAW_SQL = f"SELECT ITEM_NO, DESCRIPTION, VENDOR_NAME, CATEGORY, SUBCATEGORY, '$' || CAST(CAST(floor(COST) AS BIGINT) AS VARCHAR) || ',00 EA' AS COST, substr(ITEM_NO, 1, 3) AS _note, VENDOR_NAME AS _cat_id FROM {LI}"


def _raw_inventory(spark, d) -> DataFrame:
    """The inventory as text, with odd measure cells and columns named like helpers."""
    inv = lineitem_inventory(spark, d)
    cost = F.concat(F.lit("$"), F.floor("COST").cast("string"), F.lit(",00 EA"))
    return inv.select("ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "CATEGORY", "SUBCATEGORY", cost.alias("COST"), F.substring("ITEM_NO", 1, 3).alias("_note"), F.col("VENDOR_NAME").alias("_cat_id"))


def _land(df: DataFrame, path: str) -> None:
    """``df`` as CSV files, written by Spark alone."""
    with compiled(df.sparkSession), released(df.sparkSession):
        df.write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def _q_run_csv_full():
    q = Q.Sql()
    _inv(q)
    q.add("raw", RAW_SQL)
    cols = ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "CATEGORY", "SUBCATEGORY", "COST", "_note", "_cat_id"]
    q.add("nt", "SELECT " + ", ".join(f"{null_tokens_sql(c)} AS {c}" for c in cols) + " FROM raw")
    lab = Q.category_label(q, Q.category_trace(q, "nt"))
    fl = Q.facility_label(q, Q.facility_trace(q, lab))
    dl = Q.description_label(q, Q.description_trace(q, fl), None)
    return q.query(f"SELECT {', '.join(cols)}, {Q.PC}, {Q.FS}, SIMPLE_DESCRIPTION FROM {dl}")


@register("run_csv_full", _q_run_csv_full())
def run_csv_full(spark, d):
    """W1 from CSV to CSV, every cell as the user wrote it."""
    from ..session import work_path

    base = work_path(spark, "run-csv")
    _land(_raw_inventory(spark, d), f"{base}/in")
    run(spark, f"{base}/in", f"{base}/out", Options(multi_line=False))
    return spark.read.option("header", True).option("escape", '"').csv(f"{base}/out/csv")


def _q_csv_mixed():
    q = Q.Sql()
    _inv(q)
    q.add("raw", f"SELECT ITEM_NO, DESCRIPTION, VENDOR_NAME, CASE WHEN length(ITEM_NO) % 3 = 2 THEN CATEGORY END AS EXTRA FROM {LI}")
    return q.query("SELECT " + ", ".join(f"{null_tokens_sql(c)} AS {c}" for c in ("ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "EXTRA")) + " FROM raw")


@register("csv_mixed_layouts", _q_csv_mixed())
def csv_mixed_layouts(spark, d):
    """S1 over files of three layouts: cells go by header."""
    from ..session import work_path

    base = work_path(spark, "mixed")
    inv = lineitem_inventory(spark, d).withColumnRenamed("CATEGORY", "EXTRA")
    each = (["ITEM_NO", "DESCRIPTION", "VENDOR_NAME"], ["VENDOR_NAME", "ITEM_NO", "DESCRIPTION"], ["EXTRA", "DESCRIPTION", "VENDOR_NAME", "ITEM_NO"])
    for i, cols in enumerate(each):
        _land(inv.where(F.length("ITEM_NO") % 3 == i).select(cols), f"{base}/{i}")
    back = S.read_inventory_csv(spark, [f"{base}/{i}" for i in range(len(each))], multi_line=False)
    return back.select("ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "EXTRA")


def _q_folder_mixed():
    q = Q.Sql()
    _inv(q)
    q.add("nt", f"{_q_null_tokens_body()} WHERE length(ITEM_NO) % 3 <> 2")
    lab = Q.category_label(q, Q.category_trace(q, "nt"))
    return q.query(
        f"SELECT 'rows' AS kind, {Q.PC} AS label, count(*) AS n FROM {lab} GROUP BY 2 "
        "UNION ALL SELECT 'file', 'Missing required columns: VENDOR_NAME', 1 UNION ALL SELECT 'columns', 'EXTRA', 1"
    )


@register("folder_mixed", _q_folder_mixed())
def folder_mixed(spark, d):
    """W3 over a plain file, one with a further column, one of a header alone and one that lacks a column."""
    from ..session import work_path
    from ..streaming.folder import FILES_SCHEMA, file_counts, quarantine, run_folder

    base, inv = work_path(spark, "folder-mixed"), lineitem_inventory(spark, d)
    k = F.length("ITEM_NO") % 3
    _land(inv.where(k == 0), f"{base}/in/plain")
    _land(inv.where(k == 1).withColumn("EXTRA", F.lit("x")), f"{base}/in/extra")
    _land(inv.limit(0), f"{base}/in/header")
    _land(inv.where(k == 2).drop("VENDOR_NAME"), f"{base}/in/lacking")
    run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", Options(skip_facility=True, skip_descriptions=True, multi_line=False))
    rows = file_counts(spark, f"{base}/out").groupBy(F.col(f"`{CATEGORY_COL}`").alias("label")).agg(F.sum("rows").alias("n"))
    files = quarantine(spark, f"{base}/out").groupBy(F.col("reason").alias("label")).agg(F.count_distinct("reason").alias("n"))
    done = spark.read.schema(FILES_SCHEMA).parquet(f"{base}/out/files").where("status = 'done'")
    more = done.select(F.explode(F.array_except("columns", F.array(*map(F.lit, inv.columns)))).alias("label")).groupBy("label").agg(F.count_distinct("label").alias("n"))
    named = [x.select(F.lit(kind).alias("kind"), "label", "n") for kind, x in (("rows", rows), ("file", files), ("columns", more))]
    return named[0].unionByName(named[1]).unionByName(named[2])


# --- answers that repeat, stay, or are still to come -----------------------------------------

def _q_categories_applied():
    q = Q.Sql()
    _cat_requests_sql(q)
    q.add("ccomp", X.scripted_completions_sql("SELECT * FROM creq"))
    lab = Q.category_label(q, "c4", Q.label_answers(q, "cans", "ccomp", CATEGORY_LABELS))
    return q.query(f"SELECT ITEM_NO, DESCRIPTION, {Q.PC} FROM {lab}")


@register("apply_completions_duplicates", _q_categories_applied())
def apply_completions_duplicates(spark, d):
    """L3: an older answer and a repeated one for each request; rows neither multiply nor change."""
    inv = _matched(lineitem_inventory(spark, d))
    reqs = L.requests(C.categorize(inv, trace=True), "category")
    now = X.scripted_completions(reqs).withColumn("batch_id", F.lit(2))
    old = X.scripted_completions(reqs, X.ANSWERS[::-1]).withColumn("batch_id", F.lit(1))
    out = C.categorize(inv, completions=now.unionByName(old).unionByName(now))
    return out.select("ITEM_NO", "DESCRIPTION", CATEGORY_COL)


@register("durable_answers", _q_categories_applied())
def durable_answers(spark, d):
    """K2: answers appended twice to a store, read back and applied."""
    from ..session import work_path
    from ..sinks import append_completions, read_completions

    inv = _matched(lineitem_inventory(spark, d))
    reqs = stored(L.pending(L.requests(C.categorize(inv, trace=True), "category")), "requests")
    store = work_path(spark, "answers")
    append_completions(X.scripted_completions(reqs, X.ANSWERS[::-1]), store, "category", 1)
    append_completions(X.scripted_completions(reqs), store, "category", 2)
    return C.categorize(inv, completions=read_completions(spark, store)).select("ITEM_NO", "DESCRIPTION", CATEGORY_COL)


def _q_pending_attempts():
    q = Q.Sql()
    _desc_requests_sql(q)
    q.add("att", X.scripted_attempts_sql("SELECT * FROM dreq"))
    r = Q.resolve_attempts_sql(q, "att")
    return q.query(f"SELECT * FROM (SELECT DISTINCT * FROM dreq) d WHERE NOT EXISTS (SELECT 1 FROM {r} r WHERE r.request_id = d.request_id AND r.description IS NOT NULL)")


@register("pending_attempts", _q_pending_attempts())
def pending_attempts(spark, d):
    """L2/L4: description requests that are neither answered nor failed three times, from a log that repeats rows."""
    reqs = _desc_requests(spark, d)
    log = X.scripted_attempts(reqs)
    return L.pending(reqs, L.finished(L.resolve_attempts(log.unionByName(log))))


def _q_ranked():
    q = Q.Sql()
    fl = _classified_sql(q)
    q.add("g", f"SELECT {Q.PC} AS label, count(*) AS items FROM {fl} WHERE {Q.PC} IS NOT NULL GROUP BY 1")
    return q.query("SELECT label, items, row_number() OVER (ORDER BY items DESC, label) AS rank FROM g")


@register("distribution_ranked", _q_ranked())
def distribution_ranked(spark, d):
    """G1: categories by count, then label, with their place."""
    ranked = R.ranked(R.distribution(_classified(spark, d), CATEGORY_COL))
    return ranked.select("label", F.col("count").alias("items"), "rank")


def _q_batch_inventory():
    q = Q.Sql()
    res = _pipeline_sql(q, _inv(q))
    return q.query(f"SELECT ITEM_NO, DESCRIPTION, {Q.PC}, {Q.FS}, SIMPLE_DESCRIPTION FROM {res}")


@register("batch_run_inventory", _q_batch_inventory())
def batch_run_inventory(spark, d):
    """W1 with every stage over the whole inventory."""
    with noted() as made:
        df = _matched(lineitem_inventory(spark, d))
        comp, attempts = _answers_for(df, CLI_DEFAULTS)
        out = build(df, CLI_DEFAULTS, comp, attempts).select("ITEM_NO", "DESCRIPTION", CATEGORY_COL, FACILITY_COL, SIMPLE_DESC_COL)
    let_go(spark, made, out)
    return out


def _q_report_inventory():
    q = Q.Sql()
    fl = _classified_sql(q)
    q.add("n", f"SELECT {Q.PC} AS c, {Q.FS} AS f, count(*) AS n FROM {fl} GROUP BY 1, 2")
    q.add("t", "SELECT sum(n) AS total FROM n")

    def lines(col: str, section: int) -> str:
        return (
            f"SELECT {section} AS section, CAST(items AS BIGINT) AS sort_count, label AS sort_label, "
            f"label || ': ' || CAST(items AS VARCHAR) || ' (' || printf('%.1f', {Q.percent_expr('items', 'total')}) || '%)' AS line "
            f"FROM (SELECT {col} AS label, sum(n) AS items FROM n WHERE {col} IS NOT NULL GROUP BY 1) g, t"
        )

    cells = " || ', ' || ".join(f"{sql_str(v + '=')} || CAST(coalesce(sum(n) FILTER (WHERE f = {sql_str(v)}), 0) AS VARCHAR)" for v in FACILITY_LABELS)
    return q.query(
        "SELECT 0 AS section, CAST(0 AS BIGINT) AS sort_count, '' AS sort_label, 'Total items processed: ' || CAST(total AS VARCHAR) AS line FROM t "
        f"UNION ALL {lines('c', 1)} UNION ALL {lines('f', 2)} "
        f"UNION ALL SELECT 3, CAST(0 AS BIGINT), c, c || ': ' || {cells} FROM n WHERE c IS NOT NULL AND f IS NOT NULL GROUP BY c"
    )


@register("summary_inventory", _q_report_inventory())
def summary_inventory(spark, d):
    """K3 over the whole inventory (without the sample, which needs a unique key)."""
    return R.summary_report(_classified(spark, d), "ITEM_NO", skip_descriptions=True, seed=SAMPLE_SEED)

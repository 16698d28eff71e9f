"""Scalar text functions as Spark Columns, each with a portable SQL twin.

The SQL twins return SQL text usable by Spark SQL and DuckDB alike; the oracle
queries and ``spark.sql`` users build on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import (
    DESCRIPTION_ERROR_PREFIX,
    NA_TOKENS,
    NEEDS_REVIEW,
    NO,
    PY_WHITESPACE_RANGES,
    YES,
)


def sql_str(s: str | None) -> str:
    """SQL string literal."""
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def _ws_class() -> str:
    parts = []
    for lo, hi in PY_WHITESPACE_RANGES:
        if lo == hi:
            parts.append("\\x{%x}" % lo)
        else:
            parts.append("\\x{%x}-\\x{%x}" % (lo, hi))
    return "[" + "".join(parts) + "]"


WS_CLASS = _ws_class()
STRIP_PATTERN = "^" + WS_CLASS + "+|" + WS_CLASS + "+$"


# --- P1 blank / present -----------------------------------------------------

def blank(c: Column) -> Column:
    """Null or the empty string (a single space is not blank)."""
    return c.isNull() | (c == F.lit(""))


def present(c: Column) -> Column:
    """Non-null and non-empty: the truthiness test applied to optional text."""
    return c.isNotNull() & (c != F.lit(""))


def blank_sql(e: str) -> str:
    return f"({e} IS NULL OR {e} = '')"


def present_sql(e: str) -> str:
    return f"({e} IS NOT NULL AND {e} <> '')"


# --- S4 null tokens -----------------------------------------------------------

def null_tokens(c: Column) -> Column:
    """Whole-cell missing-value tokens become null."""
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def null_tokens_sql(e: str) -> str:
    toks = ", ".join(sql_str(t) for t in NA_TOKENS)
    return f"CASE WHEN {e} IN ({toks}) THEN NULL ELSE {e} END"


# --- P8..P10 answer clean-up ----------------------------------------------------

def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace as Python's str.strip() does."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def py_strip_sql(e: str) -> str:
    return f"regexp_replace({e}, {sql_str(STRIP_PATTERN)}, '', 'g')"


def spark_py_strip_sql(e: str) -> str:
    """Spark SQL form (replaces all matches without a flag)."""
    return f"regexp_replace({e}, {sql_str(STRIP_PATTERN)}, '')"


def after_colon(c: Column) -> Column:
    """If the answer holds a colon keep its second colon field, stripped."""
    second = F.get(F.split(c, ":", -1), F.lit(1))
    return F.when(c.contains(":"), py_strip(second)).otherwise(c)


def normalize_label(answer: Column, labels: list[str], fallback: str = NEEDS_REVIEW) -> Column:
    """Map a free-text answer onto a closed label list.

    strip -> keep second colon field -> exact label, else the first label (in
    list order) contained case-insensitively, else ``fallback``. A missing
    answer gives ``fallback``.
    """
    r = after_colon(py_strip(answer))
    lr = F.lower(r)
    return F.coalesce(
        F.when(r.isin(labels), r),
        *[F.when(lr.contains(F.lit(lab.lower())), F.lit(lab)) for lab in labels],
        F.lit(fallback),
    )


def normalize_label_sql(e: str, labels: list[str], fallback: str = NEEDS_REVIEW) -> str:
    """DuckDB form; ``e`` must already be stripped and colon-cut (see below)."""
    inlist = ", ".join(sql_str(x) for x in labels)
    whens = " ".join(
        f"WHEN contains(lower({e}), {sql_str(lab.lower())}) THEN {sql_str(lab)}" for lab in labels
    )
    return f"CASE WHEN {e} IN ({inlist}) THEN {e} {whens} ELSE {sql_str(fallback)} END"


def after_colon_sql(e: str) -> str:
    return f"CASE WHEN contains({e}, ':') THEN {py_strip_sql(f'split_part({e}, {sql_str(chr(58))}, 2)')} ELSE {e} END"


def normalize_yes_no(answer: Column) -> Column:
    """``yes`` (any case, stripped) -> Yes; any other answer -> No; none -> Needs Review."""
    return (
        F.when(answer.isNull(), F.lit(NEEDS_REVIEW))
        .when(F.lower(py_strip(answer)) == F.lit("yes"), F.lit(YES))
        .otherwise(F.lit(NO))
    )


def normalize_yes_no_sql(e: str) -> str:
    return (
        f"CASE WHEN {e} IS NULL THEN {sql_str(NEEDS_REVIEW)} "
        f"WHEN lower({py_strip_sql(e)}) = 'yes' THEN 'Yes' ELSE 'No' END"
    )


def clean_description(answer: Column) -> Column:
    """Strip whitespace, then strip surrounding double and single quotes."""
    return F.btrim(py_strip(answer), F.lit("\"'"))


def clean_description_sql(e: str) -> str:
    return f"trim({py_strip_sql(e)}, {sql_str(chr(34) + chr(39))})"


def description_error(err: Column) -> Column:
    return F.concat(F.lit(DESCRIPTION_ERROR_PREFIX), err)


# --- P12 / P13 ------------------------------------------------------------------

def percent(count: Column, total: Column) -> Column:
    """count / total * 100 in double, in that order."""
    return (count / total) * F.lit(100.0)


def percent_sql(count: str, total: str) -> str:
    return f"(CAST({count} AS DOUBLE) / CAST({total} AS DOUBLE)) * 100e0"


def cost_estimate(tokens: Column) -> Column:
    from .vocab import COST_PER_1K_TOKENS

    return (tokens.cast("double") / F.lit(1000.0)) * F.lit(COST_PER_1K_TOKENS)

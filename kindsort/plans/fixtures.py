"""Deterministic stand-ins for model answers, derived by Spark from the requests.

The registered queries need completion and attempt tables.  Instead of
invented data, the answers are a pure function of each request's text length,
so they grow with the input tables and DuckDB can derive the very same rows.
The answer texts exercise the normalisation rules (colons, list numbers,
Unicode spaces, several labels in one answer, empty answers).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql_str
from ..operators.enrich import pending

# answers to category/facility requests, picked by length(context) % len
ANSWERS = [
    "Rural Clinics",
    "3. Both Settings",
    "both rural clinics and district hospitals",
    "Category: Both",
    "Both: any setting",
    "x: y: Both",
    " \tDistrict Hospitals\n",
    "\u00a0Both\u00a0",
    ":Both",
    "Answer:",
    "1. PPE & Infection Control",
    "ppe & infection control",
    "PPE and Infection Control",
    "",
    "Medical Equipment & Furniture",
    "Category: Diagnostics & Lab Use",
    "cleaning & facility maintenance",
    "Medical & Surgical Supplies",
]
YES_NO_ANSWERS = ["yes", " YES ", "No", "maybe", "Yes."]
UNANSWERED_EVERY = 4  # requests with length % 4 == 0 get no answer


def _len(c: str = "context") -> Column:
    return F.length(F.col(c)).cast("long")


def scripted_completions(reqs: DataFrame, answers: list[str] = ANSWERS, all_answered: bool = False) -> DataFrame:
    """``(request_id, response)`` of the distinct requests: of all, or leaving some unanswered
    (for queries about requests that stay open)."""
    L = _len()
    return (
        pending(reqs)
        .filter(F.lit(all_answered) | (F.pmod(L, F.lit(UNANSWERED_EVERY)) != 0))
        .select("request_id", F.get(F.array(*[F.lit(a) for a in answers]), F.pmod(L, F.lit(len(answers))).cast("int")).alias("response"))
    )


def scripted_answer(pdf: pd.DataFrame) -> pd.Series:
    """Completer function for L8 (pandas, runs inside the tasks)."""
    n = pdf["context"].str.len()
    return n.map(lambda k: ANSWERS[int(k) % len(ANSWERS)])


def scripted_attempts(reqs: DataFrame, all_tried: bool = False) -> DataFrame:
    """Attempt log: ``length % 5`` attempts per request (0 = none yet, 4 = one too many);
    with ``all_tried`` one to four attempts for every request."""
    L = _len()
    made = F.pmod(F.col("_L"), F.lit(4)) + 1 if all_tried else F.pmod(F.col("_L"), F.lit(5))
    r = pending(reqs).select("request_id", L.alias("_L")).filter(made >= 1)
    r = r.select("request_id", "_L", F.explode(F.sequence(F.lit(1).cast("long"), made)).alias("_i"))
    ok = F.pmod(F.col("_L") + F.col("_i"), F.lit(3)) == 0
    responded = ok | (F.pmod(F.col("_L") + F.col("_i"), F.lit(4)) == 0)
    return r.select(
        "request_id",
        F.col("_i").cast("int").alias("attempt"),
        responded.alias("responded"),
        F.when(ok, F.concat(F.lit(' "Simple item '), F.col("_L").cast("string"), F.lit("'  "))).alias("response"),
        F.when(~responded, F.concat(F.lit("e"), F.col("_i").cast("string"))).alias("error"),
        F.when(responded, F.pmod(F.col("_L"), F.lit(50)) + F.lit(10) + F.col("_i")).cast("long").alias("total_tokens"),
    )


# --- SQL twins ---------------------------------------------------------------------------

def _sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"


def scripted_completions_sql(reqs_sql: str, answers: list[str] = ANSWERS, all_answered: bool = False) -> str:
    return f"""
SELECT request_id, ({_sql_list(answers)})[CAST(length(context) % {len(answers)} AS BIGINT) + 1] AS response
FROM (SELECT DISTINCT request_id, context FROM ({reqs_sql}) q) r
WHERE {all_answered} OR length(context) % {UNANSWERED_EVERY} <> 0
"""


def scripted_attempts_sql(reqs_sql: str, all_tried: bool = False) -> str:
    return f"""
SELECT request_id, CAST(i AS INTEGER) AS attempt,
       ((L + i) % 3 = 0 OR (L + i) % 4 = 0) AS responded,
       CASE WHEN (L + i) % 3 = 0 THEN ' "Simple item ' || CAST(L AS VARCHAR) || '''  ' END AS response,
       CASE WHEN NOT ((L + i) % 3 = 0 OR (L + i) % 4 = 0) THEN 'e' || CAST(i AS VARCHAR) END AS error,
       CASE WHEN ((L + i) % 3 = 0 OR (L + i) % 4 = 0) THEN CAST(L % 50 + 10 + i AS BIGINT) END AS total_tokens
FROM (SELECT DISTINCT request_id, CAST(length(context) AS BIGINT) AS L FROM ({reqs_sql}) q) r,
     (SELECT CAST(unnest(range(1, 5)) AS BIGINT) AS i) g
WHERE i <= {'L % 4 + 1' if all_tried else 'L % 5'}
"""

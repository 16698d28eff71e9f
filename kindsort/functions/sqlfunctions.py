"""The classifiers as SQL functions, for those who write ``spark.sql`` (also table-valued ones).

The functions are SQL themselves, generated from the vocabularies, so Catalyst inlines
them: no UDF, no Python, and filters, pruning and code generation work as for any query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .rules import ordered_rules
from .vocab import (
    BOTH,
    CATEGORY_COL,
    CATEGORY_RULES,
    DISTRICT,
    DISTRICT_KEYWORDS,
    FACILITY_COL,
    NEEDS_REVIEW,
    REVIEW_KEYWORDS,
    RURAL,
    RURAL_KEYWORDS,
    UNCATEGORIZED,
    distinct_in_order,
)


def literal(text: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lowered, {literal(w)})" for w in distinct_in_order(words)) + ")"


def definitions() -> list[str]:
    """The statements that create the functions, each after those it uses."""
    rules = ordered_rules(CATEGORY_RULES)
    keyword = " ".join(f"WHEN contains(lowered, {literal(k)}) THEN {literal(k)}" for k, _ in rules)
    label = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in rules)
    head = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return [
        f"{head} lowered_keyword(lowered STRING) RETURNS STRING RETURN CASE {keyword} END",
        f"{head} category_keyword(text STRING) RETURNS STRING RETURN lowered_keyword(lower(text))",
        f"{head} keyword_category(keyword STRING) RETURNS STRING RETURN CASE keyword {label} END",
        f"{head} product_category(description STRING, subcategory STRING) RETURNS STRING RETURN "
        f"CASE WHEN description IS NULL OR description = '' THEN {literal(UNCATEGORIZED)} ELSE coalesce(keyword_category(category_keyword(description)), "
        f"CASE WHEN subcategory <> '' THEN keyword_category(category_keyword(subcategory)) END, {literal(NEEDS_REVIEW)}) END",
        f"{head} needs_review(lowered STRING) RETURNS BOOLEAN RETURN {_any(REVIEW_KEYWORDS)}",
        f"{head} fits_rural(lowered STRING) RETURNS BOOLEAN RETURN {_any(RURAL_KEYWORDS)}",
        f"{head} fits_district(lowered STRING) RETURNS BOOLEAN RETURN {_any(DISTRICT_KEYWORDS)}",
        f"{head} facility_flags(description STRING) RETURNS TABLE (review BOOLEAN, rural BOOLEAN, district BOOLEAN) RETURN "
        "SELECT needs_review(l), fits_rural(l), fits_district(l) FROM (SELECT lower(description) AS l)",
        f"{head} facility_suitability(description STRING) RETURNS STRING RETURN "
        f"CASE WHEN description IS NULL OR description = '' OR needs_review(lower(description)) THEN {literal(NEEDS_REVIEW)} "
        f"WHEN fits_rural(lower(description)) AND fits_district(lower(description)) THEN {literal(BOTH)} "
        f"WHEN fits_rural(lower(description)) THEN {literal(RURAL)} WHEN fits_district(lower(description)) THEN {literal(DISTRICT)} ELSE {literal(NEEDS_REVIEW)} END",
    ]


def register_functions(spark: SparkSession) -> None:
    """Creates, in this session: ``category_keyword(text)``, ``product_category(description,
    subcategory)``, ``facility_suitability(description)`` and the table-valued
    ``facility_flags(description)``; labels are those of rows without answers."""
    for statement in definitions():
        spark.sql(statement)


def register_results(result: DataFrame, name: str = "inventory") -> None:
    """Views over a classified table: ``<name>``, ``<name>_categories``, ``<name>_facilities`` and ``<name>_crosstab``.

    ``result`` is read by each query of a view, so give a written table."""
    spark = result.sparkSession
    result.createOrReplaceTempView(name)

    def counted(view: str, columns: list[str]) -> None:
        have = [c for c in columns if c in result.columns]
        if have == columns:
            cells = ", ".join(f"`{c}`" for c in columns)
            known = " AND ".join(f"`{c}` IS NOT NULL" for c in columns)
            spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}_{view}` AS SELECT {cells}, count(*) AS items FROM `{name}` WHERE {known} GROUP BY {cells}")

    counted("categories", [CATEGORY_COL])
    counted("facilities", [FACILITY_COL])
    counted("crosstab", [CATEGORY_COL, FACILITY_COL])

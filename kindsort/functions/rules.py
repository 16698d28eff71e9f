"""Rule compiler: keyword vocabularies held as data, compiled to Columns or SQL.

Two forms of the same rules:

* literal form (default): the vocabulary becomes one ``coalesce(when(contains))``
  chain (ordered first match) or an ``OR`` of ``contains`` (any match) inside a
  single Project.  No shuffle, no join, whole-stage codegen, short-circuit on
  the first hit.  Right for vocabularies of a few hundred words.
* table form: a ``rules`` DataFrame ``(rule_set, priority, keyword, label)``, see
  :mod:`kindsort.functions.rulejoin`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import sql_str
from .vocab import (
    CATEGORY_RULES,
    DISTRICT_KEYWORDS,
    REVIEW_KEYWORDS,
    RURAL_KEYWORDS,
    distinct_in_order,
)

RULES_SCHEMA = T.StructType(
    [
        T.StructField("rule_set", T.StringType(), False),
        T.StructField("priority", T.IntegerType(), False),
        T.StructField("keyword", T.StringType(), False),
        T.StructField("label", T.StringType(), True),
    ]
)

def rule_rows() -> list[tuple[str, int, str, str | None]]:
    """All built-in vocabularies as rule rows (lists kept as written)."""
    rows = [("category", i, kw, lab) for i, (kw, lab) in enumerate(CATEGORY_RULES)]
    for name, words in (
        ("rural", RURAL_KEYWORDS),
        ("district", DISTRICT_KEYWORDS),
        ("review", REVIEW_KEYWORDS),
    ):
        rows += [(name, i, w, None) for i, w in enumerate(words)]
    return rows


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULES_SCHEMA)


def ordered_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """First occurrence of each keyword wins (a later duplicate can never fire)."""
    seen = set()
    out = []
    for kw, lab in rules:
        if kw not in seen:
            seen.add(kw)
            out.append((kw, lab))
    return out


# --- literal form ---------------------------------------------------------------

def first_match_keyword(text_lc: Column, rules: list[tuple[str, str]]) -> Column:
    """The first keyword (in rule order) contained in ``text_lc``, else null.

    One CASE with a branch a keyword: it compiles to less code than as many cases in a
    coalesce, so a stage that holds it stays a method that the JVM compiles."""
    return reduce(lambda case, rule: case.when(text_lc.contains(F.lit(rule[0])), F.lit(rule[0])), ordered_rules(rules), F)


def keyword_label(keyword: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of a keyword returned by :func:`first_match_keyword` (null stays null)."""
    pairs = []
    for kw, lab in ordered_rules(rules):
        pairs += [F.lit(kw), F.lit(lab)]
    return F.create_map(*pairs)[keyword]


def first_match(text_lc: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first matching rule, else null."""
    return F.coalesce(
        *[F.when(text_lc.contains(F.lit(kw)), F.lit(lab)) for kw, lab in ordered_rules(rules)]
    )


def any_match(text_lc: Column, words: list[str]) -> Column:
    """True when any word is contained in ``text_lc`` (null text gives null)."""
    return reduce(or_, [text_lc.contains(F.lit(w)) for w in distinct_in_order(words)])


# --- SQL form -------------------------------------------------------------------

def first_match_keyword_sql(e: str, rules: list[tuple[str, str]]) -> str:
    whens = " ".join(
        f"WHEN contains({e}, {sql_str(kw)}) THEN {sql_str(kw)}" for kw, _ in ordered_rules(rules)
    )
    return f"CASE {whens} END"


def keyword_label_sql(e: str, rules: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN {sql_str(kw)} THEN {sql_str(lab)}" for kw, lab in ordered_rules(rules))
    return f"CASE {e} {whens} END"


def any_match_sql(e: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, {sql_str(w)})" for w in distinct_in_order(words)) + ")"

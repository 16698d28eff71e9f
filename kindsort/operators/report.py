"""Reports: distributions, cross-tab, counts, progress, samples, summary (A*, G*, K3).

All are aggregations with partial (map-side) combine; the outputs are one row
per label, so even a label carried by a third of all rows is reduced inside
each task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, percent
from ..functions.vocab import (
    CATEGORY_COL,
    FACILITY_COL,
    FACILITY_LABELS,
    SAMPLE_SIZE,
    SIMPLE_DESC_COL,
)
from .enrich import with_row_index


# ---------------------------------------------------------------------------
# FIXED VALUES
# words of the report that other programs read
TOTAL_PREFIX = "Total items processed: "
ORIGINAL_PREFIX = "Original: "
SIMPLE_PREFIX = "Simple  : "
MISSING_TEXT = "nan"
# ---------------------------------------------------------------------------

# headings of the report's sections (ours)
HEADINGS = {
    1: "Items by product category",
    2: "Items by facility suitability",
    3: "Product category by facility suitability",
    4: "Sample of descriptions",
}


def _total(counts: DataFrame, col: str) -> Column:
    """Sum of a counted (checkpointed) table as a scalar subquery: a number from each task."""
    return counts.agg(F.coalesce(F.sum(col), F.lit(0)).cast("long").alias("total")).scalar()


def distribution(df: DataFrame, col: str) -> DataFrame:
    """A1/A2 + P12: ``(label, count, pct)``; nulls are not listed but count in the total.

    The input is read once, to a checkpointed row per label (preserved labels are
    free text, so there may be many); the total is the sum of those, and no task
    sees all of them.  The null group is dropped through an aggregate value
    (``_nn``), not a filter on the label: a filter on a grouping key would be
    pushed below the aggregate and into the classification expressions."""
    c = F.col(f"`{col}`")
    g = df.groupBy(c.alias("label")).agg(F.count(F.lit(1)).alias("count"), F.count(c).alias("_nn")).checkpoint()
    pct = percent(F.col("count"), _total(g, "count"))
    return g.filter(F.col("_nn") > 0).select("label", "count", pct.alias("pct"))


def ranked(dist: DataFrame, name: str = "rank") -> DataFrame:
    """G1: ``dist`` with its place from 1, most frequent first, ties by label; no task sorts all labels."""
    order = dist.withColumn("_least", -F.col("count"))
    return with_row_index(order, ["_least", "label"], name=name).withColumn(name, F.col(name) + 1).drop("_least")


def ordered(dist: DataFrame) -> DataFrame:
    """G1: most frequent first, ties by label."""
    return dist.orderBy(F.desc("count"), F.asc("label"))


def crosstab(
    df: DataFrame,
    row: str = CATEGORY_COL,
    col: str = FACILITY_COL,
    values: list[str] = FACILITY_LABELS,
    weight: str | None = None,
) -> DataFrame:
    """A3: contingency table; rows with a null on either axis are dropped, zeros filled.

    The pivot values are given, so no extra job looks for them."""
    r, c = F.col(f"`{row}`"), F.col(f"`{col}`")
    # one conditional count per given value (a pivot with fixed values); the
    # null row label and labels without a non-null column value are dropped
    # after the aggregate, so no filter is pushed into the classification
    if weight is None:
        cells = [F.count_if(c == F.lit(v)).alias(v) for v in values]
    else:  # rows are pre-counted: add up their weights
        w = F.col(weight)
        cells = [F.coalesce(F.sum(F.when(c == F.lit(v), w)), F.lit(0)).cast("long").alias(v) for v in values]
    g = df.groupBy(r.alias("label")).agg(*cells, F.count(c).alias("_nn"), F.count(r).alias("_nr"))
    return g.filter((F.col("_nn") > 0) & (F.col("_nr") > 0)).drop("_nn", "_nr")


def global_counts(df: DataFrame, traced: bool = True) -> DataFrame:
    """A4: one row of counts in a single pass."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    if CATEGORY_COL in df.columns:
        c = F.col(f"`{CATEGORY_COL}`")
        aggs += [F.count(c).alias("category_not_null"), F.count_if(blank(c)).alias("category_blank")]
    if "DESCRIPTION" in df.columns:
        aggs.append(F.count_if(blank(F.col("DESCRIPTION"))).alias("description_blank"))
    if traced and "_cat_src" in df.columns:
        aggs += [
            F.count_if(F.col("_cat_src") == "preserved").alias("category_preserved"),
            F.count_if(F.col("_cat_src") == "residual").alias("category_residual"),
        ]
    if traced and "_fac_src" in df.columns:
        aggs.append(F.count_if(F.col("_fac_src") == "residual").alias("facility_residual"))
    return df.agg(*aggs)


def distinct_labels(df: DataFrame) -> DataFrame:
    """A5: number of distinct categories and facility types seen."""
    aggs = [F.count_distinct(F.col(f"`{CATEGORY_COL}`")).alias("categories")]
    if FACILITY_COL in df.columns:
        aggs.append(F.count_distinct(F.col(f"`{FACILITY_COL}`")).alias("facility_types"))
    return df.agg(*aggs)


def stage_progress(traced: DataFrame) -> DataFrame:
    """A6 (table form): rows per stage and deciding source, from the trace columns."""
    stages = [(s, f"_{p}_src") for s, p in (("category", "cat"), ("facility", "fac"), ("electricity", "ele"), ("description", "desc"))]
    present = [(s, c) for s, c in stages if c in traced.columns]
    pairs = ", ".join(f"'{s}', {c}" for s, c in present)
    long = traced.selectExpr(f"stack({len(present)}, {pairs}) AS (stage, source)")
    return long.groupBy("stage", "source").agg(F.count(F.lit(1)).alias("rows"))


def observe_progress(df: DataFrame, name: str = "progress", at: str = ""):
    """A6 (live form): attach an Observation with processed/decided counts.

    Returns ``(df, observation)``; ``observation.get`` holds the metrics once an
    action on ``df`` has run (streams report them in ``recentProgress``).
    ``at`` is the path of the trace columns, such as ``_trace.``."""
    from pyspark.sql import Observation

    obs = Observation(name)
    have = df.select(f"{at}*").columns if at else df.columns
    metrics = [F.count(F.lit(1)).alias("rows")]
    for stage, p in (("category", "_cat_src"), ("facility", "_fac_src"), ("description", "_desc_src")):
        if p in have:
            metrics.append(F.count_if(F.col(f"{at}{p}") == "residual").alias(f"{stage}_residual"))
    return df.observe(obs, *metrics), obs


def observe_open(df: DataFrame, name: str = "open", at: str = ""):
    """An Observation of ``rows`` and, a stage, of the rows that neither a rule nor an answer has settled (``<stage>_open``)."""
    from pyspark.sql import Observation

    obs = Observation(name)
    have = df.select(f"{at}*").columns if at else df.columns
    metrics = [F.count(F.lit(1)).alias("rows")]
    for stage, p in (("category", "_cat"), ("facility", "_fac"), ("description", "_desc")):
        if f"{p}_src" in have:
            answer = F.col(f"{at}{p}_rid_a").isNull() if f"{p}_rid_a" in have else F.lit(True)
            metrics.append(F.count_if((F.col(f"{at}{p}_src") == "residual") & answer).alias(f"{stage}_open"))
    return df.observe(obs, *metrics), obs


def sample(df: DataFrame, key: str, seed: int = 42, n: int = SAMPLE_SIZE) -> DataFrame:
    """Repeatable sample of exactly ``min(n, rows)`` rows.

    Rows are ranked by ``md5(seed || key)``; TakeOrderedAndProject keeps ``n``
    rows per task, so nothing large reaches one task."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col(f"`{key}`").cast("string")))
    return df.orderBy(h, F.col(f"`{key}`")).limit(n)


def sample_state(df: DataFrame, key: str, seed: int = 42, n: int = SAMPLE_SIZE, by: list[str] | None = None) -> DataFrame:
    """G3 in parts: the ``n`` rows of the smallest ``md5(seed || key)``, of each group ``by`` if given, with ``_place``.

    What a file or batch stores of itself; every task keeps its own ``n`` rows a group."""
    place = F.md5(F.concat(F.lit(str(seed)), F.col(f"`{key}`").cast("string")))
    rows = df.withColumn("_place", place)
    if not by:
        return rows.orderBy("_place", F.col(f"`{key}`")).limit(n)
    order = Window.partitionBy(*(F.col(f"`{c}`") for c in by)).orderBy("_place", F.col(f"`{key}`"))
    number = "_number"
    return rows.withColumn(number, F.row_number().over(order)).where(F.col(number) <= n).drop(number)


def merged_sample(states: DataFrame, key: str, n: int = SAMPLE_SIZE, by: list[str] | None = None) -> DataFrame:
    """G3 of all rows from the stored parts of :func:`sample_state`: the same rows that :func:`sample` picks, without a second pass.

    A row among the first ``n`` of all is among the first ``n`` of its part."""
    if not by:
        return states.orderBy("_place", F.col(f"`{key}`")).limit(n).drop("_place")
    order = Window.partitionBy(*(F.col(f"`{c}`") for c in by)).orderBy("_place", F.col(f"`{key}`"))
    return states.withColumn("_number", F.row_number().over(order)).where(F.col("_number") <= n).drop("_number", "_place")


def _fmt_pct(c: Column) -> Column:
    """One decimal, rounded half-even on the exact binary value (as Python's
    ``'%.1f'``); ``format_string`` would round the shortest decimal form half-up
    (18.95 -> 19.0 instead of 18.9).  Percentages stay below 1,000, so the
    grouping separator of ``format_number`` never appears."""
    return F.format_number(c, 1)


def summary_report(
    df: DataFrame,
    key: str,
    skip_facility: bool = False,
    skip_descriptions: bool = False,
    seed: int = 42,
) -> DataFrame:
    """K3 as rows ``(section, sort_count, sort_label, line)``; :func:`headed` adds the headings.

    Sections: 0 totals, 1 category distribution, 2 facility distribution,
    3 cross-tab, 4 description samples.  Sort within a section by
    ``sort_count`` descending then ``sort_label``.

    One pass over the result counts its (category, facility) pairs into a
    checkpointed table, and every count section is computed from that; the
    sample is a second pass that keeps ``SAMPLE_SIZE`` rows per task."""
    has_fac = (not skip_facility) and FACILITY_COL in df.columns
    keys = [F.col(f"`{CATEGORY_COL}`").alias("cat")]
    if has_fac:
        keys.append(F.col(f"`{FACILITY_COL}`").alias("fac"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    total = _total(counts, "n")
    head = [F.lit(0).alias("section"), F.lit(0).cast("long").alias("sort_count"), F.lit("").alias("sort_label")]
    parts = [counts.sparkSession.range(1).select(*head, F.concat(F.lit(TOTAL_PREFIX), total.cast("string")).alias("line"))]

    def dist_lines(col: str, section: int) -> DataFrame:
        d = counts.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.sum("n").alias("count"))
        pct = percent(F.col("count"), total)
        return d.select(
            F.lit(section).alias("section"),
            F.col("count").alias("sort_count"),
            F.col("label").alias("sort_label"),
            F.concat(F.col("label"), F.lit(": "), F.col("count").cast("string"), F.lit(" ("), _fmt_pct(pct), F.lit("%)")).alias("line"),
        )

    parts.append(dist_lines("cat", 1))
    if has_fac:
        parts.append(dist_lines("fac", 2))
        ct = crosstab(counts.select("cat", "fac", "n"), "cat", "fac", weight="n")
        cells = [F.concat(F.lit(f"{v}="), F.col(f"`{v}`").cast("string")) for v in FACILITY_LABELS]
        parts.append(
            ct.select(
                F.lit(3).alias("section"),
                F.lit(0).cast("long").alias("sort_count"),
                F.col("label").alias("sort_label"),
                F.concat(F.col("label"), F.lit(": "), F.concat_ws(", ", *cells)).alias("line"),
            )
        )
    if (not skip_descriptions) and SIMPLE_DESC_COL in df.columns:
        s = sample(df, key, seed)
        parts.append(
            s.select(
                F.lit(4).alias("section"),
                F.lit(0).cast("long").alias("sort_count"),
                F.md5(F.concat(F.lit(str(seed)), F.col(f"`{key}`").cast("string"))).alias("sort_label"),
                F.concat(
                    F.lit(ORIGINAL_PREFIX), F.coalesce(F.col("DESCRIPTION"), F.lit(MISSING_TEXT)),
                    F.lit("\n" + SIMPLE_PREFIX), F.coalesce(F.col(SIMPLE_DESC_COL), F.lit(MISSING_TEXT)),
                ).alias("line"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def headed(report: DataFrame, title: str, facts: dict[str, str]) -> DataFrame:
    """K3: the report as ordered ``(section, place, sort_count, sort_label, line)`` with a title,
    its ``facts`` (input, output, time, ...) and a heading above each section that has lines."""
    spark = report.sparkSession
    top = [title, "=" * len(title), *(f"{k}: {v}" for k, v in facts.items())]
    rows = [(0, i - len(top), 0, "", line) for i, line in enumerate(top)]
    rows += [(k, i - 3, 0, "", line) for k, text in HEADINGS.items() for i, line in enumerate(("", text, "-" * len(text)))]
    heads = spark.createDataFrame(rows, "section int, place int, sort_count long, sort_label string, line string")
    heads = heads.join(report.select("section").distinct(), "section", "left_semi")
    return heads.unionByName(report.withColumn("place", F.lit(0)))

"""Model fallback re-aimed as batch enrichment.

Rows no rule decided become request rows; answers come back as tables and are
joined on the request id.  Nothing here calls a network service: the
pluggable completer (L8) runs a user function over Arrow batches of distinct
pending requests, partitioned by Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_description, cost_estimate, description_error
from ..functions.vocab import CATEGORY_LABELS, FACILITY_LABELS, MAX_ATTEMPTS, NO, STAGE_PARAMS, YES
from ..session import stored
from .classify import DIGEST

STAGE_PREFIX = {"category": "_cat", "facility": "_fac", "electricity": "_ele", "description": "_desc"}

# ---------------------------------------------------------------------------
# FIXED VALUES
# error text of a response that arrived without text (it is counted in the
# usage totals and then retried)
EMPTY_RESPONSE_ERROR = "'NoneType' object has no attribute 'strip'"
# ---------------------------------------------------------------------------

REQUEST_SCHEMA = "request_id string, stage string, context string, max_tokens int, temperature double"
COMPLETION_SCHEMA = "request_id string, response string"
ATTEMPT_SCHEMA = (
    "request_id string, attempt int, responded boolean, response string, error string, total_tokens long"
)


# --- L1 what a request asks for ---------------------------------------------------------

REQUEST_KIND_SCHEMA = "stage string, instruction string, labels array<string>, max_tokens int, temperature double"


def request_kinds(spark: SparkSession) -> DataFrame:
    """One row a stage: what whoever answers its requests must know besides their context.

    ``labels`` lists the only answers that are taken (null: free text)."""
    asked = {
        "category": ("Pick the product category that fits the item best. Reply with one of the labels and nothing else.", CATEGORY_LABELS),
        "facility": ("Say which kind of health facility can use the item, given its equipment, staff and power supply. Reply with one of the labels and nothing else.", FACILITY_LABELS),
        "electricity": ("Say whether the item needs mains electricity or batteries to work. Reply with one of the labels and nothing else.", [YES, NO]),
        "description": ("The context is the whole request. Reply with the description only.", None),
    }
    rows = [(stage, text, labels, *STAGE_PARAMS[stage]) for stage, (text, labels) in asked.items()]
    return spark.createDataFrame(rows, REQUEST_KIND_SCHEMA)


# --- L1 residue requests ----------------------------------------------------------

def requests(traced: DataFrame, stage: str, ready: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """One request row per residual row of ``stage`` (needs ``trace=True`` output).

    ``ready`` (optional) holds back rows whose request would still change, e.g.
    facility requests of rows whose category answer has not arrived.  ``keep``
    (optional) names columns that come out beside each request."""
    p = STAGE_PREFIX[stage]
    max_tokens, temperature = STAGE_PARAMS[stage]
    req = F.struct(
        F.col(f"{p}_rid").alias("request_id"),
        F.lit(stage).alias("stage"),
        F.col(f"{p}_ctx").alias("context"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
        F.lit(temperature).cast("double").alias("temperature"),
    )
    # explode(when(residual, [request])) instead of filter(residual): a Filter
    # on a trace column would be pushed below the rule projections and inline
    # the whole keyword chain (and the source expressions) into the scan or
    # join condition; the generator keeps the chain evaluated once per row.
    cond = F.col(f"{p}_src") == "residual"
    if ready is not None:
        cond = cond & ready
    one = F.when(cond, F.array(req))
    return traced.select(*(keep or []), F.explode(one).alias("_req")).select("_req.*", *(keep or []))


# --- L2 distinct pending requests ----------------------------------------------------

def pending(reqs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Each distinct request once, minus those already answered.

    ``dropDuplicates`` aggregates map-side first, so a context repeated on a
    third of all rows is reduced before the shuffle."""
    r = reqs.dropDuplicates(["request_id"])
    if done is not None:
        r = r.join(done.select("request_id"), "request_id", "left_anti")
    return r


def packed_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with ``request_id`` as the 32 bytes of the digest: half of its text, of which LZ4 saves nothing in a shuffle.

    Ids that are no such digest are no request's and stay out."""
    return rows.where(F.col("request_id").rlike(DIGEST)).withColumn("request_id", F.unhex("request_id"))


def spelled_ids(rows: DataFrame) -> DataFrame:
    """``request_id`` as text again."""
    return rows.withColumn("request_id", F.lower(F.hex("request_id")))


# --- L4 attempts, L5 usage ------------------------------------------------------------

def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """Per request: first successful answer among the first three attempts.

    Output ``(request_id, description, ok_attempt, attempts, responses, tokens)``:
    ``description`` is the cleaned answer; without one it is ``Error generating
    description: <error of the last attempt>`` after the third attempt and null
    before, as the request is to be tried again (:func:`finished`).
    ``responses``/``tokens`` count responded attempts up to the first success
    (later attempts are never made).  An attempt that the log repeats counts
    once: the one with a response, then with the largest values.

    One aggregate with a value for each attempt number, combined map-side: three
    values a request, however many log rows it has.
    """
    row = F.struct(F.coalesce("responded", F.lit(False)).alias("responded"), "response", "error", F.coalesce("total_tokens", F.lit(0)).cast("long").alias("tokens"))
    numbers = range(1, MAX_ATTEMPTS + 1)
    g = attempts.filter(F.col("attempt").between(1, MAX_ATTEMPTS)).groupBy("request_id").agg(
        *(F.max(F.when(F.col("attempt") == i, row)).alias(f"a{i}") for i in numbers)
    )
    ok = {i: F.coalesce(F.col(f"a{i}.responded") & F.col(f"a{i}.response").isNotNull(), F.lit(False)) for i in numbers}
    first = F.coalesce(*(F.when(ok[i], i) for i in numbers))
    text = F.coalesce(*(F.when(ok[i], F.col(f"a{i}.response")) for i in numbers))
    g = g.withColumn("ok_attempt", first.cast("int")).withColumn("_text", text)
    upto = F.coalesce("ok_attempt", F.lit(MAX_ATTEMPTS))
    counted = {i: F.coalesce(F.col(f"a{i}.responded"), F.lit(False)) & (F.lit(i) <= upto) for i in numbers}
    last = F.coalesce(*(F.when(F.col(f"a{i}").isNotNull(), F.coalesce(F.col(f"a{i}.error"), F.lit(EMPTY_RESPONSE_ERROR))) for i in reversed(numbers)))

    def total(values) -> Column:
        return reduce(add, values).cast("long")

    return g.select(
        "request_id",
        F.when(F.col("ok_attempt").isNotNull(), clean_description(F.col("_text")))
        .when(F.col(f"a{MAX_ATTEMPTS}").isNotNull(), description_error(last))
        .alias("description"),
        "ok_attempt",
        total(F.col(f"a{i}").isNotNull().cast("long") for i in numbers).alias("attempts"),
        total(counted[i].cast("long") for i in numbers).alias("responses"),
        total(F.when(counted[i], F.col(f"a{i}.tokens")).otherwise(0) for i in numbers).alias("tokens"),
    )


def finished(resolved: DataFrame) -> DataFrame:
    """``request_id`` of the requests that need no further attempt: answered, or failed three times."""
    return resolved.where(F.col("description").isNotNull()).select("request_id")


def usage(resolved: DataFrame) -> DataFrame:
    """Responses received, tokens and the cost estimate."""
    return resolved.agg(
        F.coalesce(F.sum("responses"), F.lit(0)).cast("long").alias("total_requests"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
    ).withColumn("est_cost", cost_estimate(F.col("total_tokens")))


# --- L6/L7 positions ---------------------------------------------------------------------

def with_row_index(df: DataFrame, order_cols: list[str], name: str = "_row", partitions: int | None = None) -> DataFrame:
    """Dense 0-based position of each row in ``order_cols`` order (unique key).

    Distributed: range-partition on the key and sort inside each partition;
    ``monotonically_increasing_id`` then holds (partition, position in the
    partition).  The tagged rows are written once, so the per-partition
    counts and the rows come from the same assignment: the range bounds are
    sampled with a seed tied to the plan, and two separately planned
    exchanges can cut the key range differently.  The counts of earlier
    partitions are added from one small row per partition, broadcast.  One
    shuffle; no step moves all rows into one task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = stored(
        df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).withColumn("_mid", F.monotonically_increasing_id()),
        "indexed",
    )
    pid = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: the running sum is over `n` rows only
    offsets = counts.select(
        "_pid", (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_off")
    )
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    return (
        tagged.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + local).cast("long"))
        .drop("_pid", "_mid", "_off")
    )


def first_rows(df: DataFrame, order_cols: list[str], n: int, name: str = "_row") -> DataFrame:
    """0-based position of the first ``n`` rows in ``order_cols`` order (unique key), null for the others.

    Each task keeps its own first ``n`` keys; the ``n`` that remain are joined back.
    The rows themselves are neither sorted nor shuffled.  ``n`` is the user's number."""
    keys = [f"{name}_{i}" for i in range(len(order_cols))]
    top = df.select(*(F.col(c).alias(k) for c, k in zip(order_cols, keys, strict=True))).orderBy(*keys).limit(n)
    placed = top.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(order_cols, keys, strict=True)))
    side = F.broadcast(placed) if n <= FIRST_BROADCAST else placed
    return df.join(side, same, "left").drop(*keys)


# first-n requests above this are joined by shuffle
FIRST_BROADCAST = 100_000


def batch_of(position: Column, size: int) -> Column:
    """Batch number of a 0-based position."""
    return F.floor(position / F.lit(size)).cast("long")


# --- L8 pluggable completer ----------------------------------------------------------------

def complete_with(
    reqs: DataFrame,
    answer: Callable[[pd.DataFrame], pd.Series],
    done: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Run ``answer`` over Arrow batches of distinct pending requests.

    ``answer`` receives a pandas frame with the request columns and returns
    one response per row (None = failed).  ``partitions`` sets how many tasks
    call it at once (the throttle knob)."""
    todo = pending(reqs, done)
    if partitions:
        todo = todo.repartition(partitions, "request_id")

    def run(batches):
        for pdf in batches:
            out = answer(pdf)
            yield pd.DataFrame({"request_id": pdf["request_id"], "response": pd.Series(out, index=pdf.index, dtype=object)})

    return todo.mapInPandas(run, COMPLETION_SCHEMA)


def empty_completions(spark) -> DataFrame:
    return spark.createDataFrame([], COMPLETION_SCHEMA)

"""Pipelines W1/W2: options -> one lazily built DataFrame -> sinks -> report.

Categorise and facility run in the same Project (map-only); each answer table
adds one join on the request id.  The result is written once and the reports
read the written table back (two columns, pruned at the scan), so a lost
executor only recomputes its own tasks and nothing is cached across jobs.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import CATEGORY_COL, FACILITY_COL, SIMPLE_DESC_COL
from ..operators.classify import MATCHED, TEXT_COLS, categorize, describe, facility, with_request
from ..operators.enrich import batch_of, finished, first_rows, packed_ids, pending, request_kinds, requests, resolve_attempts, spelled_ids, with_row_index
from ..operators.report import headed, observe_progress, summary_report
from ..session import let_go, noted, stored
from ..sinks import RunRecord, write_csv, write_parquet, write_report
from ..sinks.store import AnswerStore
from ..sources.inventory import MARK, added, data_columns, fresh, layouts, looked_at, position_column, read_inventory_csv, read_rejects


@dataclass(frozen=True)
class Options:
    preserve_existing: bool = True
    skip_facility: bool = False
    skip_descriptions: bool = False
    batch_size: int = 50
    description_batch: int | None = None
    multi_line: bool = True


# command-line defaults (every stage on) and form defaults (only categories)
CLI_DEFAULTS = Options()
FORM_DEFAULTS = Options(skip_facility=True, skip_descriptions=True)

OUTPUTS = (CATEGORY_COL, FACILITY_COL, SIMPLE_DESC_COL)
# names that the stages use for their helper columns
HELPER = re.compile(r"_(d|match|row|(cat|fac|ele|desc)_\w+)", re.I)


def shielded(df: DataFrame, row_col: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns that are named like helpers renamed, and their names by the new ones."""
    back: dict[str, str] = {}
    names = list(df.columns)
    marked = set(df.columns) - set(data_columns(df))
    for c in df.columns:
        if HELPER.fullmatch(c) and c not in marked and c != row_col:
            new = fresh([*names, *back], "__kept")
            back[new] = c
    forth = {c: new for new, c in back.items()}
    return df.select(*(F.col(f"`{c}`").alias(forth.get(c, c), metadata=df.schema[c].metadata) for c in df.columns)), back


def build(
    df: DataFrame,
    opts: Options = CLI_DEFAULTS,
    completions: DataFrame | None = None,
    attempts: DataFrame | None = None,
    row_col: str = "_row",
    trace: str | None = None,
    contexts: bool = False,
    ids: bool = True,
) -> DataFrame:
    """S1 output -> C3 -> [C6] -> [C8] as one DataFrame.

    All columns of ``df`` come out under their names, then the outputs.  With
    ``trace`` the helper columns of the stages follow as one struct of that name: with
    ``contexts`` also the request texts, and without ``ids`` no request ids.
    :func:`traced_rows` has both again from the written rows."""
    row = row_col if opts.description_batch else None
    given, back = shielded(df, row)
    with noted() as made:
        x = categorize(given, opts.preserve_existing, completions, trace=True, contexts=contexts)
        if not opts.skip_facility:
            x = facility(x, completions, trace=True, contexts=contexts)
        if not opts.skip_descriptions:
            resolved = resolve_attempts(attempts) if attempts is not None else None
            if resolved is not None:
                if not trace:
                    x = x.select(*(f"`{c}`" for c in x.columns if c in (*given.columns, *OUTPUTS) and x.schema[c].metadata != MATCHED))
                let_go(df.sparkSession, made, x)  # what an earlier stage wrote and a later one wrote again
            x = describe(x, resolved, first_n=opts.description_batch, row_col=row_col, trace=True, contexts=contexts)
            if resolved is not None:
                let_go(df.sparkSession, made, x)
    outputs = [c for c in OUTPUTS if c in x.columns and c not in given.columns]
    kept = [F.col(f"`{c}`").alias(back.get(c, c), metadata=given.schema[c].metadata) for c in given.columns if given.schema[c].metadata != MATCHED]
    if not trace:
        return x.select(*kept, *(f"`{c}`" for c in outputs))
    helpers = [c for c in x.columns if c not in outputs and c not in ("_d", "_match") and (c not in given.columns or given.schema[c].metadata == MATCHED)]
    helpers = [c for c in helpers if ids or not re.fullmatch("_(cat|fac|desc)_rid", c)]
    return x.select(*kept, *(f"`{c}`" for c in outputs), F.struct(*helpers).alias(trace))


def alike(columns: list[str]) -> bool:
    """Whether a column is named as one that request texts are made of but for its case: then they are not worked out again by name."""
    return any(c not in TEXT_COLS and c.lower() in {t.lower() for t in TEXT_COLS} for c in columns)


def traced_rows(written: DataFrame, trace: str, keep: list | None = None) -> DataFrame:
    """Written rows of ``build(..., trace=trace)`` as :func:`stage_requests` takes them."""
    return written.select(*(keep or []), *(f"`{c}`" for c in TEXT_COLS if c in written.columns), f"{trace}.*")


def stage_requests(traced: DataFrame, opts: Options = CLI_DEFAULTS, keep: list[str] | None = None) -> DataFrame:
    """L1 for every stage that ran, from the trace columns (:func:`traced_rows`)."""
    out = requests(with_request(traced, "category"), "category", keep=keep)
    if not opts.skip_facility:
        # a facility request carries the category: ask it once the category is
        # settled (decided by a rule, or its answer row has arrived)
        settled = F.col("_cat_src") != "residual"
        if "_cat_rid_a" in traced.columns:
            settled = settled | F.col("_cat_rid_a").isNotNull()
        out = out.unionByName(requests(with_request(traced, "facility"), "facility", ready=settled, keep=keep))
    if not opts.skip_descriptions:
        out = out.unionByName(requests(with_request(traced, "description"), "description", keep=keep))
    return out


def run(
    spark: SparkSession,
    input_path: str | list[str],
    output_path: str,
    opts: Options = CLI_DEFAULTS,
    completions: DataFrame | None = None,
    attempts: DataFrame | None = None,
    csv: bool = True,
    seed: int = 42,
    store: str | None = None,
) -> RunRecord:
    """W1 end to end: read + validate, classify, write, emit requests, report.

    Writes under ``output_path``: ``table`` (the input's columns, the outputs, the
    trace as one struct, parquet), ``csv`` (the widened inventory in input order),
    ``rejects`` (rows with more fields than their header), ``requests`` (distinct
    requests still to be answered, in batches of ``opts.batch_size``),
    ``request_kinds`` (what each stage's requests ask for), ``summary`` and
    ``run_record`` (seconds and rows of each stage, one run after the other).

    ``completions`` are added to the answer ``store`` (if one is named: a folder, see
    :class:`kindsort.sinks.store.AnswerStore`) and the stored answers of earlier runs are
    applied with them.  Running again with the
    answers to ``requests`` applies them; facility requests carry the category, so
    they are issued once the category answers are there.  A description request
    comes again until it is answered or has failed three times."""
    began = datetime.now(timezone.utc)
    rec = RunRecord(spark)
    if store is not None:
        kept = AnswerStore(spark, store)
        if completions is not None:
            kept.append(completions, int(time.time() * 1000))
        completions = kept
    found = layouts(spark, input_path)
    found = looked_at(spark, found) if opts.multi_line else found
    surplus = Observation()
    df = read_inventory_csv(spark, input_path, multi_line=opts.multi_line, found=found, surplus=surplus)
    pos = position_column(df)
    order = [added(df, "file"), pos]  # files by name, then the order in each
    row = fresh(df, "_row")
    if opts.description_batch:
        df = first_rows(df, order, opts.description_batch, name=row)
        df = df.withColumn(row, F.col(row).alias(row, metadata={MARK: "row"}))
    trace = fresh([*df.columns, *OUTPUTS], "_trace")
    table = f"{output_path}/table"
    with noted() as made:
        traced, seen = observe_progress(build(df, opts, completions, attempts, row_col=row, trace=trace, contexts=alike(df.columns)), at=f"{trace}.")
        rec.timed("classify", lambda: (write_parquet(traced, table), spark.read.parquet(table).count())[1])
    let_go(spark, made)
    rec.progress["classify"] = seen.get
    written = spark.read.parquet(table)
    result = written.drop(trace)
    # the files are read a second time only if the first reading left rows out
    left = found if surplus.get["rows"] else [g for g in found if not g.columns]
    rec.timed("rejects", lambda: (write_parquet(read_rejects(spark, input_path, opts.multi_line, left), f"{output_path}/rejects"), spark.read.parquet(f"{output_path}/rejects").count())[1])
    if csv:
        rec.timed("csv", lambda: (write_csv(result, f"{output_path}/csv", order_by=order), None)[1])
    answers = completions.answers() if isinstance(completions, AnswerStore) else completions
    done = answers.select("request_id") if answers is not None else None
    if attempts is not None:
        tried = finished(resolve_attempts(attempts))
        done = tried if done is None else done.unionByName(tried)
    with noted() as made:
        # written in between, so the shuffle of the one step is gone when the other's comes
        todo = stored(pending(packed_ids(stage_requests(traced_rows(written, trace), opts)), packed_ids(done) if done is not None else None), "pending")
        todo = with_row_index(todo, ["stage", "request_id"], name="place")
        let_go(spark, made, todo)
        todo = spelled_ids(todo.withColumn("batch", batch_of(F.col("place"), opts.batch_size)).drop("place"))
        rec.timed("requests", lambda: (write_parquet(todo, f"{output_path}/requests"), spark.read.parquet(f"{output_path}/requests").count())[1])
    let_go(spark, made)
    write_parquet(request_kinds(spark), f"{output_path}/request_kinds")
    rep = summary_report(result, pos, opts.skip_facility, opts.skip_descriptions, seed)
    facts = {"Input": str(input_path), "Output": output_path, "Started": began.isoformat(timespec="seconds"), "Seconds": f"{(datetime.now(timezone.utc) - began).total_seconds():.1f}"}
    rec.timed("report", lambda: (write_report(headed(rep, "Inventory classification", facts), f"{output_path}/summary"), None)[1])
    rec.append_to(f"{output_path}/run_record")
    return rec


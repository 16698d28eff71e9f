"""Registered queries of the streams: requests issued once, answers applied, files replaced, faults, progress, durable answers."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import null_tokens_sql, sql_str
from ..functions.vocab import CATEGORY_COL, CATEGORY_LABELS, FACILITY_COL
from ..session import compiled, released, setting, stored, work_path
from ..sources.testview import lineitem_inventory
from . import fixtures as X
from . import sqlforms as Q
from .batch import FORM_DEFAULTS, Options
from .catalog import LI, _cat_requests, _cat_requests_sql, _inv, _land, _q_folder_stream, _q_null_tokens_body, register

STAGES = Options(skip_facility=False, skip_descriptions=True)
#: Slices that the inventory lands in, by the length and last digit of the item number.
SLICES = 4


def _slice() -> F.Column:
    return F.pmod(F.length("ITEM_NO") + F.substring("ITEM_NO", -1, 1).cast("int"), F.lit(SLICES))


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _place(spark: SparkSession, df: DataFrame, folder: str, scratch: str, **options: str) -> None:
    """``df`` as the files ``0.csv``, ``1.csv``, ... of a folder, in place of those that it holds."""
    with compiled(spark), released(spark):
        df.write.options(**({"header": "true", "escape": '"', "emptyValue": '""'} | options)).csv(scratch)
    _put(spark, scratch, folder)


def _put(spark: SparkSession, made: str, folder: str) -> None:
    """The files that Spark wrote in ``made`` as ``0.csv``, ``1.csv``, ... of a folder, in place of those that it holds."""
    path, fs = _files(spark, folder)
    fs.mkdirs(path(folder))
    names = sorted(s.getPath().toString() for s in fs.listStatus(path(made)) if s.getPath().getName().startswith("part-"))
    for i, name in enumerate(names):
        fs.delete(path(f"{folder}/{i}.csv"), False)
        fs.rename(path(name), path(f"{folder}/{i}.csv"))


PART = "__part"


def _land_parts(spark: SparkSession, df: DataFrame, parts: list[str], made: str) -> dict[str, str]:
    """The rows by column ``PART`` as CSV files in a folder of its own each, all in one pass; the folders of ``parts``.

    A part without rows gets a file with the header alone, as :func:`_land` writes it."""
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(len(parts))), compiled(spark), released(spark):
        df.where(F.col(PART).isin(parts)).write.partitionBy(PART).options(header="true", escape='"', emptyValue='""').csv(made)
    path, fs = _files(spark, made)
    folders = {}
    for part in parts:
        folders[part] = f"{made}/{PART}={part}"
        if not fs.exists(path(folders[part])):
            folders[part] = f"{made}-none/{part}"
            _land(df.drop(PART).limit(0), folders[part])
    return folders


def _arrive(spark: SparkSession, made: str, folder: str) -> None:
    """A folder of written files put where they are looked for, at once."""
    path, fs = _files(spark, folder)
    fs.mkdirs(path(folder).getParent())
    if not fs.rename(path(made), path(folder)):
        raise OSError(f"{made} could not be renamed to {folder}")


def _land_slices(spark: SparkSession, inv: DataFrame, made: str) -> dict[str, str]:
    return _land_parts(spark, inv.withColumn(PART, _slice().cast("string")), [str(i) for i in range(SLICES)], made)


def _traced_sql(q: Q.Sql) -> str:
    _inv(q)
    q.add("nt", _q_null_tokens_body())
    return Q.category_trace(q, "nt")


def _q_stream_requests():
    q = Q.Sql()
    t = _traced_sql(q)
    q.add("creq", Q.requests_sql(t, "category", "_cat"))
    ft = Q.facility_trace(q, Q.category_label(q, t))
    q.add("freq", Q.requests_sql(f"(SELECT * FROM {ft} WHERE _cat_src <> 'residual')", "facility", "_fac"))
    return q.query("SELECT DISTINCT * FROM creq UNION ALL SELECT DISTINCT * FROM freq")


@register("stream_requests", _q_stream_requests())
def stream_requests(spark, d):
    """L1/L2 in W3: four landings, two before the first run, and a restart; each request comes out once ever."""
    from ..streaming.folder import issued_requests, run_folder

    base = work_path(spark, "stream-requests")
    made = _land_slices(spark, lineitem_inventory(spark, d), f"{base}/made")
    for i in range(SLICES):
        _arrive(spark, made[str(i)], f"{base}/in/{i}")
        if i % 2:
            run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", STAGES)
    run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", STAGES)
    return issued_requests(spark, f"{base}/out")


def _q_stream_answers():
    q = Q.Sql()
    t = _traced_sql(q)
    q.add("creq", Q.requests_sql(t, "category", "_cat"))
    q.add("ccomp", X.scripted_completions_sql("SELECT * FROM creq"))
    lab = Q.category_label(q, t, Q.label_answers(q, "cans", "ccomp", CATEGORY_LABELS))
    return q.query(f"SELECT {Q.PC}, count(*) AS n_rows FROM {lab} GROUP BY 1")


@register("stream_answers", _q_stream_answers())
def stream_answers(spark, d):
    """L3 in W3: the stream issues requests, the answers come, and the files that wait for them are labelled anew."""
    from ..streaming.folder import file_counts, issued_requests, run_folder

    base = work_path(spark, "stream-answers")
    _land(lineitem_inventory(spark, d), f"{base}/in")
    run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", FORM_DEFAULTS)
    given = stored(X.scripted_completions(issued_requests(spark, f"{base}/out")), "completions")
    run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", FORM_DEFAULTS, completions=given)
    return file_counts(spark, f"{base}/out").groupBy(CATEGORY_COL).agg(F.sum("rows").cast("long").alias("n_rows"))


@register("folder_versions", _q_folder_stream())
def folder_versions(spark, d):
    """A1-A3 over W3 where files are replaced at their paths: counts of the first versions are taken back."""
    from ..streaming.folder import file_counts, run_folder

    base, inv = work_path(spark, "versions"), lineitem_inventory(spark, d)
    # each row of a replaced file twice: as it is first, and as it is then
    wrong = F.when((_slice() < 2) & (F.length("ITEM_NO") > 1), F.struct(F.concat(F.lit("first"), _slice()).alias(PART), F.concat(F.lit("glove "), F.col("ITEM_NO")).alias("DESCRIPTION")))
    right = F.struct(F.concat(F.when(_slice() < 2, "then").otherwise("first"), _slice()).alias(PART), "DESCRIPTION")
    rows = inv.withColumn("_as", F.explode(F.array(wrong, right))).select(*(F.col(f"_as.{c}" if c == "DESCRIPTION" else c) for c in inv.columns), f"_as.{PART}")
    made = _land_parts(spark, rows, [*(f"first{i}" for i in range(SLICES)), "then0", "then1"], f"{base}/made")
    for i in range(SLICES):
        _put(spark, made[f"first{i}"], f"{base}/in/{i}")
    run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", STAGES)
    for i in range(2):
        _put(spark, made[f"then{i}"], f"{base}/in/{i}")
    run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", STAGES)
    return file_counts(spark, f"{base}/out").groupBy(CATEGORY_COL, FACILITY_COL).agg(F.sum("rows").cast("long").alias("n_rows"))


def _q_folder_recovery():
    q = Q.Sql()
    _inv(q)
    cells = "ITEM_NO, DESCRIPTION, VENDOR_NAME"
    q.add("raw", f"SELECT {cells}, CAST(NULL AS VARCHAR) AS SUBCATEGORY FROM {LI} WHERE NOT ends_with(ITEM_NO, '7')")
    q.add("nt", "SELECT " + ", ".join(f"{null_tokens_sql(c)} AS {c}" for c in (*cells.split(", "), "SUBCATEGORY")) + " FROM raw")
    lab = Q.category_label(q, Q.category_trace(q, "nt"))
    return q.query(
        f"SELECT 'rows' AS kind, {Q.PC} AS label, count(*) AS n FROM {lab} GROUP BY 2 "
        f"UNION ALL SELECT 'rejects', 'more than 3 fields', count(*) FROM {LI} WHERE ends_with(ITEM_NO, '7') HAVING count(*) > 0 "
        "UNION ALL SELECT 'file', 'broken/0.csv', 1"
    )


@register("folder_recovery", _q_folder_recovery())
def folder_recovery(spark, d):
    """W3 with a file that breaks its batch, equal file names in two folders, and rows with too many fields: nothing else is lost."""
    from ..streaming.folder import file_counts, quarantine, run_folder

    base, inv = work_path(spark, "recovery"), lineitem_inventory(spark, d)
    head = "ITEM_NO,DESCRIPTION,VENDOR_NAME"
    plain = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0000"}
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *(cell(c) for c in head.split(",")), F.when(F.endswith("ITEM_NO", F.lit("7")), F.lit("one,too many")))
    for name, odd in (("x", 0), ("y", 1)):
        lines = inv.where(F.pmod(_slice(), F.lit(2)) == odd).select(line.alias(head))
        _place(spark, lines, f"{base}/in/{name}", f"{base}/made/{name}", **plain)
    _place(spark, inv.limit(1).select(F.repeat(F.lit(","), 30_000).alias(head)), f"{base}/in/broken", f"{base}/made/broken", **plain)
    run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", Options(skip_facility=True, skip_descriptions=True, multi_line=False))
    rows = file_counts(spark, f"{base}/out").groupBy(F.col(f"`{CATEGORY_COL}`").alias("label")).agg(F.sum("rows").alias("n"))
    bad = spark.read.schema("file string, reason string, raw string").parquet(f"{base}/out/rejects").groupBy(F.col("reason").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    gone = quarantine(spark, f"{base}/out").groupBy(F.col("file").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    named = [t.select(F.lit(kind).alias("kind"), "label", "n") for kind, t in (("rows", rows), ("rejects", bad), ("file", gone))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _q_stream_progress():
    q = Q.Sql()
    t = _traced_sql(q)
    ft = Q.facility_trace(q, Q.category_label(q, t))
    done = "count(*) FILTER (WHERE {p}_src <> 'residual')"
    return q.query(f"SELECT 'category' AS stage, count(*) AS total, {done.format(p='_cat')} AS completed FROM {ft} UNION ALL SELECT 'facility', count(*), {done.format(p='_fac')} FROM {ft}")


@register("stream_progress", _q_stream_progress())
def stream_progress(spark, d):
    """A6 in W3: what the writes of each batch observed, summed over the batches."""
    from ..streaming import folder as W

    base = work_path(spark, "progress")
    for i, made in _land_slices(spark, lineitem_inventory(spark, d), f"{base}/made").items():
        _arrive(spark, made, f"{base}/in/{i}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(f"{base}/in").select("path").count()
    W.run_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", STAGES, max_files=max(1, files // 3))
    return W.stream_progress(spark, f"{base}/out").groupBy("stage").agg(F.sum("total").alias("total"), F.sum("completed").alias("completed"))


# --- answers ---------------------------------------------------------------------------------

def _q_completer_restart():
    q = Q.Sql()
    _cat_requests_sql(q)
    arr = "[" + ", ".join(sql_str(a) for a in X.ANSWERS) + "]"
    return q.query(
        f"SELECT request_id, ({arr})[CAST(length(context) % {len(X.ANSWERS)} AS BIGINT) + 1] AS response, "
        "CAST(CASE WHEN (length(context) + 1) % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM (SELECT DISTINCT request_id, context FROM creq)"
    )


def _unsteady(asked):
    """The scripted answers, of which each request's first or second attempt in three fails."""
    out = X.scripted_answer(asked)
    return out.where((asked["context"].str.len() + asked["attempt"]) % 3 != 0, None)


def _ends_in_third_batch(asked):
    if (asked["batch_id"] >= 2).any():
        raise RuntimeError("the completer is out of service")
    return _unsteady(asked)


@register("completer_restart", _q_completer_restart())
def completer_restart(spark, d):
    """A completer that ends in its third batch keeps the first two; the next run asks the rest, each up to three times."""
    from ..streaming.completer import attempt_log, complete_stream

    base, reqs = work_path(spark, "completer"), _cat_requests(spark, d).checkpoint()
    rows = 1 + reqs.select("request_id").distinct().count() // 5
    try:
        complete_stream(reqs, f"{base}/store", f"{base}/checkpoint", _ends_in_third_batch, batch_rows=rows, partitions=8)
    except StreamingQueryException:
        pass  # the outage that this query is about
    complete_stream(reqs, f"{base}/store", f"{base}/checkpoint", _unsteady, batch_rows=rows, partitions=8)
    log = attempt_log(spark, f"{base}/store")
    return log.groupBy("request_id").agg(F.max("response").alias("response"), F.count(F.lit(1)).alias("attempts"))

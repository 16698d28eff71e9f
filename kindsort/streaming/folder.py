"""Landing-folder pipeline with Structured Streaming (S7 source).

Each CSV file that lands in the folder is one processing unit.  A run first lists the
folder and adds what is new to a ledger, ``arrivals``: a file of a path not seen yet, or
one whose time or length changed, is a further *version*.  The stream is of ledger rows,
not of CSV rows: a micro-batch is a bounded list of file versions, which are read by their
own headers (files may differ in their columns), classified with the same expressions as
the batch pipeline, and written under the batch and the file's id (from its whole path).

Of a file only the latest version counts: the counts of the one before are taken back in
the batch that replaces it, so totals are sums over all batches and always those of a run
over the files as they are.  Files whose open requests have been answered since are put in
the ledger again, so their rows are labelled anew.

Requests of rows that no rule decides go through a second stream, ``dropDuplicates`` on a
state store, so each is issued once ever, however many files, runs or replays ask it.

Faults: a batch is written in portions that keep every core busy.  A portion that fails is
tried again in halves, less the file that the fault names, so one bad file among many costs
its portion once more.  A file that cannot be used (no header, a required column missing,
unreadable) is put in ``files`` with the reason; any other fault goes down to a single file,
is tried once more there and then fails the batch, which the next run repeats.
Output of a batch is cleared before it is written, so a repeated batch replaces its own.
"""

from __future__ import annotations

import hashlib
import re
from contextlib import contextmanager
from dataclasses import replace
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import CATEGORY_COL, FACILITY_COL, REQUIRED_COLUMNS
from ..operators.enrich import REQUEST_SCHEMA, finished, resolve_attempts
from ..operators.report import observe_open
from ..plans.batch import FORM_DEFAULTS, OUTPUTS, Options, alike, build, stage_requests, traced_rows
from ..session import compiled, let_go, noted, released, setting
from ..sources.inventory import Layout, added, fresh, layouts, looked_at, position_column, read_inventory_csv, read_rejects

ARRIVALS_SCHEMA = "path string, modified timestamp, length long, version long, cause string"
FILES_SCHEMA = "file string, file_id string, path string, version long, status string, reason string, columns array<string>, batch_id long"
COUNTS_SCHEMA = f"file string, file_id string, `{CATEGORY_COL}` string, `{FACILITY_COL}` string, rows long, batch_id long"
ASKED_SCHEMA = f"{REQUEST_SCHEMA}, file_id string, open boolean, batch_id long"
PROGRESS_SCHEMA = "stage string, total long, completed long, batch_id long"
# partition columns and trace of the row tables; a file that has them is quarantined
BATCH_KEY, FILE_KEY, TRACE = "__batch", "__file", "__trace"
#: Ledger rows of a micro-batch, if the caller names no number.
FILES_A_BATCH = 10_000
#: What Spark reports where a file itself cannot be read.
READ_FAULTS = re.compile(r"FAILED_READ_FILE|MALFORMED_CSV_RECORD|MALFORMED_RECORD_IN_PARSING|TextParsingException|MalformedInputException|FileNotFoundException")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- paths -----------------------------------------------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _clear(spark: SparkSession, path: str) -> None:
    """Removes what an earlier attempt of a batch has written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "file:/", path)


def _id(path: str) -> str:
    """Id of a file from its whole path (a letter first, so that no reader takes it for a number)."""
    return "f" + hashlib.sha256(_plain(path).encode()).hexdigest()[:15]


def _id_column(file_path: Column) -> Column:
    """:func:`_id` of the path that a scan reports, which is url-encoded."""
    path = F.regexp_replace(F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    return F.concat(F.lit("f"), F.substring(F.sha2(path, 256), 1, 15))


def _with_ids(df: DataFrame, source: str, files: list[str]) -> DataFrame:
    """``df`` with the id of each row's file; the ids are worked out once a file, from the paths that a scan reports."""
    path, file = fresh(df, "__file_path"), F.col(f"`{source}`")
    scanned = df.sparkSession.read.format("binaryFile").load(files).select(F.col("_metadata.file_path").alias(path))
    ids = scanned.withColumn(FILE_KEY, _id_column(F.col(path)))
    return df.join(F.broadcast(ids), file == F.col(path), "left").drop(path).withColumn(FILE_KEY, F.coalesce(FILE_KEY, _id_column(file)))


def _name(path: str, folder: str | None) -> str:
    """A file's path within the folder; the whole path if it lies elsewhere."""
    if folder:
        base = re.sub(r"^[a-zA-Z][\w+.-]*:/*", "/", folder).rstrip("/") + "/"
        at = _plain(path).find(base)
        if at >= 0:
            return _plain(path)[at + len(base) :]
    return path


# --- S7: the ledger --------------------------------------------------------------------------

def note_arrivals(spark: SparkSession, folder: str, out_dir: str, max_files: int | None = None) -> int:
    """Adds the ``*.csv`` files of the folder that are new, or changed in time or length, to the ledger; how many.

    Only names, times and lengths are read.  A file's rows of the ledger are its versions."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(folder)
    now = listed.select("path", F.col("modificationTime").alias("modified"), "length")
    new = now.select("path", "modified", "length", F.lit(1).cast("long").alias("version"), F.lit("new").alias("cause"))
    if _exists(spark, f"{out_dir}/arrivals"):
        last = _ledger(spark, out_dir)
        old = now.alias("n").join(last.alias("o"), "path", "left")
        changed = F.col("o.version").isNull() | (F.col("n.modified") != F.col("o.modified")) | (F.col("n.length") != F.col("o.length"))
        new = old.where(changed).select(
            "path", "n.modified", "n.length", (F.coalesce("o.version", F.lit(0)) + 1).alias("version"), F.when(F.col("o.version").isNull(), "new").otherwise("changed").alias("cause")
        )
    return _add(spark, new, out_dir, max_files)


def _ledger(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest version of each file."""
    seen = spark.read.schema(ARRIVALS_SCHEMA).parquet(f"{out_dir}/arrivals")
    return seen.groupBy("path").agg(F.max_by(F.struct("modified", "length", "version"), "version").alias("v")).select("path", "v.*")


def _add(spark: SparkSession, rows: DataFrame, out_dir: str, max_files: int | None) -> int:
    rows = rows.checkpoint()  # read from the ledger that is added to
    n = rows.count()
    if n:
        most = max_files or FILES_A_BATCH
        rows.repartition(-(-n // most)).write.mode("append").option("maxRecordsPerFile", most).parquet(f"{out_dir}/arrivals")
    return n


def reopen(spark: SparkSession, out_dir: str, done: DataFrame, max_files: int | None = None) -> int:
    """Puts files again in the ledger whose latest version left requests open that are in ``done`` (``request_id``)."""
    if not _exists(spark, f"{out_dir}/asked") or not _exists(spark, f"{out_dir}/files"):
        return 0
    asked = spark.read.schema(ASKED_SCHEMA).parquet(f"{out_dir}/asked").where("open")
    latest = current(spark, out_dir).select("file_id", "batch_id", "path")
    hit = asked.join(latest, ["file_id", "batch_id"]).join(done.select("request_id"), "request_id", "left_semi").select("path").distinct()
    again = _ledger(spark, out_dir).join(hit, "path").select("path", "modified", "length", (F.col("version") + 1).alias("version"), F.lit("answered").alias("cause"))
    return _add(spark, again, out_dir, max_files)


def landing_stream(spark: SparkSession, out_dir: str) -> DataFrame:
    """The stream of file versions, at most a ledger file a micro-batch (their content is not read here)."""
    return spark.readStream.schema(ARRIVALS_SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{out_dir}/arrivals")


#: Files that a task writes to at a time.
WRITERS = 4


# --- a micro-batch ------------------------------------------------------------------------------

def _write(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows under their keys.  A task holds rows of a few files: up to ``WRITERS`` are written beside
    each other as they come, only beyond that are the rows sorted by file first."""
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(WRITERS)), compiled(df.sparkSession), released(df.sparkSession):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def _told(e: BaseException) -> str:
    """A fault's message with those of its causes."""
    said, cause = [str(e)], getattr(e, "_origin", None) or getattr(e, "java_exception", None)
    while cause is not None and len(said) < 20:
        said.append(str(cause.toString()))
        cause = cause.getCause()
    return "\n".join(said)


def _reason(e: Exception) -> str:
    said = _told(e)
    fault = re.search(r"\[((?:FAILED_READ_FILE|MALFORMED)[\w.]*)\]", said)
    return f"unreadable: {fault[1]}" if fault else f"unreadable: {type(e).__name__}"


def _unusable(layout: Layout) -> str | None:
    if not layout.columns:
        return "no header"
    if missing := [c for c in REQUIRED_COLUMNS if c not in layout.columns]:
        return f"Missing required columns: {', '.join(missing)}"
    if {c.lower() for c in layout.columns} & {BATCH_KEY, FILE_KEY, TRACE}:
        return f"a column is named {BATCH_KEY}, {FILE_KEY} or {TRACE}"
    return None


def _read_fault(write) -> str | None:
    """Runs ``write``: None if it went through, the reason if a file cannot be read.

    Any other fault (a lost executor, a full disk) is not the file's: it is tried once
    more and then raised, so the batch fails and stays to be done."""
    for last in (False, True):
        try:
            write()
            return None
        except Exception as e:  # noqa: BLE001
            if READ_FAULTS.search(_told(e)):
                return _reason(e)
            if last:
                raise
    return None


def _named(e: BaseException) -> set[str]:
    """The files that a fault's messages name."""
    return {_plain(unquote(m).rstrip(".")) for m in re.findall(r"\bfile:? +(\S+)", _told(e))}


#: A file with the layout that it is read by.
Piece = tuple[Layout, str]


def _portions(spark: SparkSession, pieces: list[Piece], lengths: dict[str, int]) -> list[list[Piece]]:
    """The files of a batch in stretches of like size, each of one to two full splits for every core."""
    full = spark.sparkContext.defaultParallelism * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    sizes = [lengths.get(_plain(f)) or 0 for _, f in pieces]
    total, before = max(1, sum(sizes)), 0
    n = max(1, total // full)
    out: dict[int, list[Piece]] = {}
    for piece, size in zip(pieces, sizes, strict=True):
        out.setdefault(before * n // total, []).append(piece)
        before += size
    return list(out.values())


def _joined(pieces: list[Piece]) -> list[Layout]:
    """The layouts of some files, with these files alone."""
    by: dict[Layout, list[str]] = {}
    for g, f in pieces:
        by.setdefault(g, []).append(f)
    return [replace(g, files=tuple(files)) for g, files in by.items()]


def _process(opts: Options, completions: DataFrame | None, out_dir: str, folder: str | None = None, attempts: DataFrame | None = None):
    def write_rows(spark: SparkSession, good: list[Layout], batch_id: int, contexts: bool) -> dict[str, int]:
        files = [f for g in good for f in g.files]
        good = looked_at(spark, good) if opts.multi_line else good
        surplus = Observation()
        df = read_inventory_csv(spark, files, multi_line=opts.multi_line, found=good, surplus=surplus)
        pos, source = position_column(df), added(df, "file")
        batch_key = F.lit(batch_id).cast("long")
        with noted() as made:
            res, seen = observe_open(build(df, opts, completions, attempts, trace=TRACE, contexts=contexts, ids=contexts), at=f"{TRACE}.")
            _write(_with_ids(res, source, files).withColumn(BATCH_KEY, batch_key).drop(pos, source), f"{out_dir}/rows", [BATCH_KEY, FILE_KEY])
        let_go(spark, made)
        # the rows themselves are read a second time only if the first reading left any out
        bad = read_rejects(spark, files, opts.multi_line, good if surplus.get["rows"] else [])
        _write(bad.withColumns({BATCH_KEY: batch_key, FILE_KEY: _id_column(F.col("file"))}), f"{out_dir}/rejects", [BATCH_KEY, FILE_KEY])
        return seen.get

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = F.col("version") if "version" in batch.columns else F.lit(1)
        # paths of one micro-batch: bounded by the size of a ledger file
        length = F.col("length") if "length" in batch.columns else F.lit(0)
        told = batch.groupBy("path").agg(F.max(version).alias("version"), F.max(length).alias("length")).collect()
        paths = {r["path"]: r["version"] for r in told}
        lengths = {_plain(r["path"]): r["length"] for r in told}
        if not paths:
            return
        for name in ("rows", "rejects"):
            _clear(spark, f"{out_dir}/{name}/{BATCH_KEY}={batch_id}")
        for name in ("asked", "counts", "files", "progress"):
            _clear(spark, f"{out_dir}/{name}/batch_id={batch_id}")
        rows: list[tuple] = []

        def note(path: str, status: str, reason: str | None, columns: tuple | None) -> None:
            rows.append((_name(path, folder), _id(path), path, paths.get(path), status, reason, list(columns) if columns else None, batch_id))

        files = sorted(paths)
        try:
            found = layouts(spark, files)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in _told(e):
                raise
            for f in [f for f in files if not _exists(spark, f)]:
                note(f, "quarantined", "the file is gone", None)
            files = [f for f in files if _exists(spark, f)]
            found = layouts(spark, files) if files else []
        for g in found:
            if why := _unusable(g):
                for f in g.files:
                    note(f, "quarantined", why, None)
        good = [g for g in found if not _unusable(g)]
        # request texts and ids are worked out again of the written rows, unless a column might be taken for another
        contexts = alike([c for g in good for c in g.columns])
        seen: list[dict[str, int]] = []

        def write_pieces(pieces: list[Piece]) -> None:
            try:
                seen.append(write_rows(spark, _joined(pieces), batch_id, contexts))
            except Exception as e:  # noqa: BLE001 - perhaps a file cannot be read: in halves, so the others get through
                if len(pieces) > 1:
                    named = _named(e)
                    alone = [p for p in pieces if _plain(p[1]) in named]
                    rest = [p for p in pieces if p not in alone]
                    half = len(rest) // 2
                    for part in (*([p] for p in alone), rest[:half], rest[half:]):
                        if part:
                            write_pieces(part)
                    return
                again = lambda: seen.append(write_rows(spark, _joined(pieces), batch_id, contexts))
                if why := _reason(e) if READ_FAULTS.search(_told(e)) else _read_fault(again):
                    for name in ("rows", "rejects"):
                        _clear(spark, f"{out_dir}/{name}/{BATCH_KEY}={batch_id}/{FILE_KEY}={_id(pieces[0][1])}")
                    note(pieces[0][1], "quarantined", why, None)
                    return
            for g, f in pieces:
                note(f, "done", None, g.columns)

        for portion in _portions(spark, [(g, f) for g in good for f in g.files], lengths):
            write_pieces(portion)
        made = spark.createDataFrame(rows, FILES_SCHEMA)
        _write_counts(spark, made, out_dir, batch_id)
        _write_asked(spark, out_dir, batch_id, opts, answered(completions, attempts))
        _write_progress(spark, seen, out_dir, batch_id)
        _write(made, f"{out_dir}/files", ["batch_id"])

    return per_batch


def answered(completions: DataFrame | None, attempts: DataFrame | None) -> DataFrame | None:
    """``request_id`` of the requests that need no further answer."""
    if hasattr(completions, "look_up"):
        completions = completions.answers()
    parts = [] if completions is None else [completions.where(F.col("response").isNotNull()).select("request_id")]
    parts += [] if attempts is None else [finished(resolve_attempts(attempts))]
    return reduce(DataFrame.union, parts).distinct() if parts else None


def _written(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame | None:
    """Rows of a written batch; None if it has none."""
    try:
        return spark.read.option("basePath", f"{out_dir}/rows").option("mergeSchema", "true").parquet(f"{out_dir}/rows/{BATCH_KEY}={batch_id}")
    except AnalysisException:
        return None  # only headers: nothing was written


def _write_counts(spark: SparkSession, files: DataFrame, out_dir: str, batch_id: int) -> None:
    """The batch's rows by file and label, and less those that its files had before."""
    columns = ["file_id", CATEGORY_COL, FACILITY_COL]
    names = files.select("file_id", "file")
    parts = []
    written = _written(spark, out_dir, batch_id)
    if written is not None:
        facility = F.col(f"`{FACILITY_COL}`") if FACILITY_COL in written.columns else F.lit(None).cast("string")
        labels = written.select(F.col(FILE_KEY).cast("string").alias("file_id"), F.col(f"`{CATEGORY_COL}`"), facility.alias(FACILITY_COL))
        parts.append(labels.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")))
    if _exists(spark, f"{out_dir}/counts"):
        before = spark.read.schema(COUNTS_SCHEMA).parquet(f"{out_dir}/counts").where(F.col("batch_id") < batch_id)
        before = before.join(F.broadcast(names.select("file_id")), "file_id", "left_semi")
        parts.append(before.groupBy(*columns).agg((-F.sum("rows")).alias("rows")).where("rows <> 0"))
    if parts:
        change = reduce(DataFrame.unionByName, parts).groupBy(*columns).agg(F.sum("rows").alias("rows")).where("rows <> 0")
        named = change.join(F.broadcast(names), "file_id").withColumn("batch_id", F.lit(batch_id).cast("long"))
        _write(named.checkpoint(), f"{out_dir}/counts", ["batch_id"])


def _write_asked(spark: SparkSession, out_dir: str, batch_id: int, opts: Options, done: DataFrame | None) -> None:
    """The requests of the batch's rows, once a file, and whether they were still open."""
    written = _written(spark, out_dir, batch_id)
    if written is None:
        return
    # an id is the digest of stage and context, so whole rows repeat: without a sort, unlike rows of one id
    traced = traced_rows(written, TRACE, [F.col(FILE_KEY).cast("string").alias("file_id")])
    reqs = stage_requests(traced, opts, keep=["file_id"]).distinct()
    if done is None:
        reqs = reqs.withColumn("open", F.lit(True))
    else:
        reqs = reqs.join(done.withColumn("open", F.lit(False)), "request_id", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    _write(reqs.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{out_dir}/asked", ["batch_id"])


def _write_progress(spark: SparkSession, seen: list[dict[str, int]], out_dir: str, batch_id: int) -> None:
    """Rows and settled rows of each stage, as the write itself observed them."""
    stages = sorted({k.removesuffix("_open") for s in seen for k in s if k.endswith("_open")})
    total = sum(s["rows"] or 0 for s in seen)
    rows = [(stage, total, total - sum(s[f"{stage}_open"] or 0 for s in seen), batch_id) for stage in stages]
    if rows:
        _write(spark.createDataFrame(rows, PROGRESS_SCHEMA), f"{out_dir}/progress", ["batch_id"])


# --- runs ----------------------------------------------------------------------------------------

@contextmanager
def unloaded(spark: SparkSession):
    """For a stream that ends: the ids compressed by zstd (LZ4 makes nothing of digests), and no copy of them left beside the checkpoint."""
    with setting(spark, "spark.sql.streaming.stateStore.rocksdb.compression", "zstd"), setting(spark, "spark.sql.streaming.stateStore.unloadOnCommit", "true"):
        yield


def issue_requests(spark: SparkSession, out_dir: str, checkpoint: str):
    """L1/L2 as a stream: each request of the ``asked`` table goes to ``requests`` once ever.

    The ids that were issued are kept in a state store that is checkpointed with the
    stream, so neither a further file nor a restart issues one again.  None if nothing
    was ever asked."""
    if not _exists(spark, f"{out_dir}/asked"):
        return None
    asked = spark.readStream.schema(ASKED_SCHEMA).parquet(f"{out_dir}/asked")
    once = asked.select(*(c.split()[0] for c in REQUEST_SCHEMA.split(", "))).dropDuplicates(["request_id"]).observe("issued", F.count(F.lit(1)).alias("requests"))
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB), unloaded(spark), released(spark):
        q = once.writeStream.format("parquet").option("compression", "zstd").outputMode("append").option("checkpointLocation", checkpoint).option("path", f"{out_dir}/requests").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_folder(
    spark: SparkSession,
    folder: str,
    out_dir: str,
    checkpoint: str,
    opts: Options = FORM_DEFAULTS,
    completions: DataFrame | None = None,
    max_files: int | None = None,
    attempts: DataFrame | None = None,
):
    """Process every file version present now, then stop (``availableNow``).

    Under ``out_dir``: ``arrivals`` (the ledger), ``rows`` (each file's widened table),
    ``counts`` (changes of its labels), ``files`` (what became of it), ``rejects``,
    ``asked`` and ``requests`` (what is to be answered, each once ever) and ``progress``.
    With ``completions`` (a table or an answer store) or ``attempts`` the files that wait
    for them are labelled anew."""
    done = answered(completions, attempts)
    if done is not None:
        reopen(spark, out_dir, done, max_files)
    note_arrivals(spark, folder, out_dir, max_files)
    if not _exists(spark, f"{out_dir}/arrivals"):
        return None  # nothing ever landed
    stream = landing_stream(spark, out_dir).observe("landed", F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    q = (
        stream.writeStream.foreachBatch(_process(opts, completions, out_dir, folder, attempts))
        .option("checkpointLocation", f"{checkpoint}/files")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    issue_requests(spark, out_dir, f"{checkpoint}/requests")
    return q


# --- results ----------------------------------------------------------------------------------------

def current(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest version of each file that was processed, as rows of the ``files`` table."""
    found = spark.read.schema(FILES_SCHEMA).parquet(f"{out_dir}/files")
    return found.groupBy(F.col("file_id").alias("id")).agg(F.max_by(F.struct(*found.columns), "batch_id").alias("f")).select("f.*")


def file_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per-file category and facility counts of the latest versions: the sum of all changes."""
    c = spark.read.schema(COUNTS_SCHEMA).parquet(f"{out_dir}/counts")
    return c.groupBy("file", f"`{CATEGORY_COL}`", f"`{FACILITY_COL}`").agg(F.sum("rows").cast("long").alias("rows")).where("rows <> 0")


def file_table(spark: SparkSession, out_dir: str, file: str) -> DataFrame:
    """The widened table of one file (its path within the folder), with the columns that it has, in its latest version."""
    last = current(spark, out_dir).where((F.col("file") == file) & (F.col("status") == "done")).first()
    at = f"{out_dir}/rows/{BATCH_KEY}={last['batch_id']}/{FILE_KEY}={last['file_id']}"
    rows = spark.read.option("basePath", f"{out_dir}/rows").parquet(at)
    outputs = [c for c in OUTPUTS if c in rows.columns and c not in last["columns"]]
    return rows.select(*(f"`{c}`" for c in [*last["columns"], *outputs]))


def issued_requests(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every request that was issued, once."""
    if not _exists(spark, f"{out_dir}/requests"):
        return spark.createDataFrame([], REQUEST_SCHEMA)
    return spark.read.schema(REQUEST_SCHEMA).parquet(f"{out_dir}/requests")


def stream_progress(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(batch_id, stage, total, completed)`` of every batch."""
    return spark.read.schema(PROGRESS_SCHEMA).parquet(f"{out_dir}/progress").select("batch_id", "stage", "total", "completed")


def quarantine(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(file, reason)`` of the files whose latest version could not be used."""
    return current(spark, out_dir).where("status = 'quarantined'").select("file", "reason")

"""Inventory sources and table checks.

CSV files are read by header: the files of a folder are grouped by their header
line, each group is read with the columns its header names, and the groups are
united by name.  All cells stay the text that the file holds (parsed measures
come as extra columns on request), cells equal to a missing-value token become
null, and rows with more fields than their header go to a table of rejects.

Columns that this module adds carry a mark in their metadata, so no column of
the input is ever mistaken for one, whatever its name.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank, null_tokens
from . import pieces
from .pieces import ends_open
from ..functions.vocab import (
    CATEGORY_COL,
    EXPECTED_COLUMNS,
    FACILITY_COL,
    PREVIEW_ROWS,
    REQUIRED_COLUMNS,
    SIMPLE_DESC_COL,
)

MEASURE_COLUMNS = [
    "AVAILABILITY_QTY", "COST", "EXT_COST", "GROSS_CUBIC", "CUBIC_FEET", "EXT_GROSS_CUBIC", "EST_PALLETS",
]
POSITION_COL = "_pos"
FILE_COL = "_file"
MARK = "kindsort"

# a cell is null only where the row has no such field; an empty cell is text
# until the missing-value tokens are applied
NO_FIELD = "\u0000"
END_MARK = "\u0001end"
CSV_READ_OPTIONS = {
    "header": "true",
    "enforceSchema": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "mode": "PERMISSIVE",
    "nullValue": NO_FIELD,
    "emptyValue": "",
    "maxCharsPerColumn": "-1",
    # a row whose cells are not all parsed is never found to have too many of them
    "columnPruning": "false",
}


def fresh(df_or_columns: DataFrame | list[str], base: str) -> str:
    """A column name not taken yet, in any case."""
    columns = df_or_columns if isinstance(df_or_columns, list) else df_or_columns.columns
    taken = {c.lower() for c in columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def added(df: DataFrame, what: str) -> str | None:
    """Name of the column that this module added as ``what`` (position or file), if any."""
    return next((f.name for f in df.schema.fields if (f.metadata or {}).get(MARK) == what), None)


def data_columns(df: DataFrame) -> list[str]:
    """The columns of the input itself."""
    return [f.name for f in df.schema.fields if MARK not in (f.metadata or {})]


def position_column(df: DataFrame) -> str:
    """The column that keeps the input order."""
    return added(df, "position") or POSITION_COL


# --- S4 --------------------------------------------------------------------------------

def normalize_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing-value tokens (whole cell, case-sensitive) -> null on string columns."""
    types = dict(df.dtypes)
    cols = columns or [c for c in data_columns(df) if types[c] == "string"]
    return df.select(*[null_tokens(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def cast_measures(df: DataFrame) -> DataFrame:
    """Measures to double by name (``try_cast``: bad text -> null); identifiers stay text.

    For computing only: a table that is written out keeps the cells as they are."""
    return df.select(
        *[F.col(f"`{c}`").try_cast("double").alias(c) if c in MEASURE_COLUMNS else F.col(f"`{c}`") for c in df.columns]
    )


# --- S1, S2 ----------------------------------------------------------------------------------

def check_required(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> None:
    """Fail listing the missing required columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


@dataclass(frozen=True)
class Layout:
    """Files that share a header; ``columns`` None: nothing in them can be read as a header."""

    columns: tuple[str, ...] | None
    files: tuple[str, ...]
    largest: int = 0  # bytes of the largest file
    long_records: bool | None = None  # whether records may go over several lines; None: not looked at


def header_of(head: str) -> tuple[str, ...] | None:
    """Column names of the first CSV record; None for a file of blank lines.

    Names that repeat (in any case) get a number, as cells are found by name."""
    row = next((r for r in csv.reader(io.StringIO(head.removeprefix("\ufeff"), newline="")) if r), None)
    if row is None:
        return None
    names: list[str] = []
    for i, name in enumerate(row):
        name = name or f"Unnamed: {i}"
        base, n = name, 0
        while name.lower() in {x.lower() for x in names}:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return tuple(names)


HEADER_BYTES = 1 << 20


def first_record(stream) -> str:
    """The text of a file up to the end of its first record that is not blank, however long it is."""
    data, at, inside = b"", 0, False
    while chunk := stream.read(HEADER_BYTES):
        data += chunk
        while (end := data.find(b"\n", at)) >= 0:
            line = data[at:end].decode("utf-8", "replace")
            inside, at = ends_open(line.removeprefix("\ufeff"), inside), end + 1
            if not inside and line.strip():
                return data[:at].decode("utf-8", "replace")
    return data.decode("utf-8", "replace")


def layouts(spark: SparkSession, paths: str | list[str]) -> list[Layout]:
    """The files under ``paths`` grouped by header, one entry a layout.

    Tasks read the first bytes of each file; the driver gets what it plans a scan
    with anyway, the file names, and one header a layout."""
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                store, name = fs.FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", path), safe="/:@"))
                with store.open_input_stream(name) as f:
                    out.append(header_of(first_record(f)))
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "header": out})

    found = listed.mapInPandas(heads, "path string, length long, header array<string>")
    groups = found.groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("files"), F.max("length").alias("largest")).collect()
    made = [Layout(tuple(g["header"]) if g["header"] is not None else None, tuple(g["files"]), g["largest"]) for g in groups]
    return sorted(made, key=lambda x: x.files)


#: A file up to this size that Spark would cut into at most so many pieces is read by one task all the same.
ONE_TASK_BYTES, ONE_TASK_PIECES = 32 << 20, 8


def _piece_bytes(spark: SparkSession) -> int:
    """The size above which files are cut for Spark's tasks."""
    cut = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(cut, min(ONE_TASK_BYTES, ONE_TASK_PIECES * cut))


def looked_at(spark: SparkSession, found: list[Layout]) -> list[Layout]:
    """The layouts of large files divided into those whose records are single lines and the others.

    One scan of the lines by Spark's own expressions.  Files of single lines, the usual
    kind, are then cut anywhere and parsed where they lie; only the others go through
    :mod:`.pieces`."""
    out = []
    cut = _piece_bytes(spark)
    large = [g for g in found if g.columns and g.long_records is None and g.largest > cut]
    long = pieces.with_long_records(spark, [f for g in large for f in g.files]) if large else set()
    known = {_spoken(f) for f in long}
    for g in found:
        if g not in large:
            out.append(g)
            continue
        for is_long in (False, True):
            if files := tuple(f for f in g.files if (_spoken(f) in known) is is_long):
                out.append(replace(g, files=files, long_records=is_long))
    return out


def _spoken(path: str) -> str:
    """A file's path without the ways in which scans write it (url-encoded or not, one slash or three)."""
    return re.sub(r"^file:/+", "/", unquote(path))


def _scan(spark: SparkSession, layout: Layout, multi_line: bool, file: str, place: str) -> tuple[DataFrame, str, Column]:
    """Rows of one layout with the raw text of rows that don't fit, its column, and whether a row has surplus fields.

    Column ``file`` names each row's file; ``place`` is its place there, null where the scan's own order tells it."""
    columns = list(layout.columns or ())
    raw = fresh([*columns, file, place], "_raw")
    options = {k: CSV_READ_OPTIONS[k] for k in ("quote", "escape", "nullValue", "emptyValue", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "mode", "maxCharsPerColumn")}
    multi_line = multi_line and layout.long_records is not False
    if multi_line and layout.largest > _piece_bytes(spark):
        df = pieces.rows(spark, list(layout.files), columns, raw, file, place, options)
    else:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, raw]])
        df = (
            spark.read.schema(schema).options(**CSV_READ_OPTIONS)
            .option("columnNameOfCorruptRecord", raw).option("multiLine", str(multi_line).lower())
            .csv(list(layout.files))
        ).withColumns({file: F.col("_metadata.file_path"), place: F.lit(None).cast("long")})
    # too few fields are nulls, as before: an end mark added to such a row stands among the header's
    # columns, in a row with too many it falls beyond them
    names = [f"c{i}" for i in range(len(columns))]
    marked = F.concat(F.regexp_replace(F.col(f"`{raw}`"), r"[\r\n]+$", ""), F.lit("," + END_MARK))
    fields = F.from_csv(marked, ", ".join(f"{c} string" for c in names), options)
    short = F.array_contains(F.array(*(fields[c] for c in names)), F.lit(END_MARK))
    # always true, and reads a column: Spark refuses to scan a file for the raw rows alone
    anchor = F.coalesce(F.length(F.col(f"`{columns[0]}`")), F.lit(0)) >= 0
    return df, raw, F.col(f"`{raw}`").isNotNull() & ~F.coalesce(short, F.lit(False)) & anchor


def read_inventory_csv(
    spark: SparkSession,
    path: str | list[str],
    validate: bool = True,
    measures: bool = False,
    multi_line: bool = True,
    found: list[Layout] | None = None,
    surplus: Observation | None = None,
) -> DataFrame:
    """Comma CSV with header, quoted multi-line fields and doubled quotes; a file, a folder or a list.

    Files may differ in the order and choice of columns: cells go by name, a
    column that a file lacks is null in its rows, and all columns come out in the
    order in which the layouts name them.  Rows with more fields than their
    header are left out here and found in :func:`read_rejects`.  A position
    column increases along each file, a file column names it (:func:`added`).

    With ``multi_line`` (quoted newlines allowed) a file is read by one task if Spark
    would not cut it.  Larger ones are scanned for quoted newlines first
    (:func:`looked_at`): without any they are cut anywhere, else read in pieces by many
    tasks (:mod:`.pieces`, three passes).  ``multi_line=False`` is one pass over files of
    any size.  ``measures`` parses the measure columns to double.  ``surplus`` observes
    how many rows were left out, as ``rows``."""
    groups = found if found is not None else layouts(spark, path)
    groups = looked_at(spark, groups) if multi_line else groups
    readable = [g for g in groups if g.columns]
    if not readable:
        raise ValueError(f"No CSV file with a header under {path}")
    if validate:
        for g in readable:
            missing = [c for c in REQUIRED_COLUMNS if c not in g.columns]
            if missing:
                raise ValueError(f"Missing required columns: {', '.join(missing)}")
    every = list(dict.fromkeys(c for g in readable for c in g.columns))
    pos, name = fresh(every, POSITION_COL), fresh(every, FILE_COL)
    left_out = fresh([*every, pos, name], "_left_out")
    parts = []
    for g in readable:
        df, raw, more = _scan(spark, g, multi_line, name, pos)
        if surplus is None:
            df = df.where(~more).drop(raw)
        else:
            df = df.withColumn(left_out, more).drop(raw)
        parts.append(normalize_nulls(df, list(g.columns)))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if surplus is not None:
        df = df.observe(surplus, F.count_if(left_out).alias("rows")).where(~F.col(left_out)).drop(left_out)
    # places of large files are told apart by a hash of the file's name in the upper bits
    placed = F.shiftleft(F.pmod(F.xxhash64(F.col(f"`{name}`")), F.lit(1 << 19)), 44) + F.col(f"`{pos}`")
    df = df.withColumn(pos, F.coalesce(placed, F.monotonically_increasing_id()))
    df = df.select(*[f"`{c}`" for c in every], F.col(f"`{name}`").alias(name, metadata={MARK: "file"}), F.col(f"`{pos}`").alias(pos, metadata={MARK: "position"}))
    return cast_measures(df) if measures else df


REJECT_SCHEMA = "file string, reason string, raw string"


def read_rejects(spark: SparkSession, path: str | list[str], multi_line: bool = True, found: list[Layout] | None = None) -> DataFrame:
    """What :func:`read_inventory_csv` leaves out: ``(file, reason, raw)``, a row each."""
    groups = found if found is not None else layouts(spark, path)
    groups = looked_at(spark, groups) if multi_line else groups
    parts = [spark.createDataFrame([(f, "no header", None) for g in groups if not g.columns for f in g.files], REJECT_SCHEMA)]
    for g in groups:
        if g.columns:
            file, place = fresh(list(g.columns), FILE_COL), fresh(list(g.columns), POSITION_COL)
            df, raw, surplus = _scan(spark, g, multi_line, file, place)
            parts.append(df.where(surplus).select(F.col(f"`{file}`").alias("file"), F.lit(f"more than {len(g.columns)} fields").alias("reason"), F.col(f"`{raw}`").alias("raw")))
    return reduce(DataFrame.unionByName, parts)


def required_columns_table(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """S2 as a table: ``(column, present, blank_rows)`` in one pass."""
    present = [c for c in required if c in df.columns]
    aggs = [F.count_if(blank(F.col(f"`{c}`"))).alias(f"b{i}") for i, c in enumerate(present)] or [F.lit(0)]
    row = df.agg(*aggs)
    entries = []
    for c in required:
        if c in present:
            entries.append(f"'{c}', true, b{present.index(c)}")
        else:
            entries.append(f"'{c}', false, CAST(NULL AS BIGINT)")
    return row.selectExpr(f"stack({len(required)}, {', '.join(entries)}) AS (column, present, blank_rows)")


# --- S3 -------------------------------------------------------------------------------------

def schema_drift(df: DataFrame, expected: list[str] = EXPECTED_COLUMNS) -> DataFrame:
    """Expected layout vs. the table: ``(column, position, status, non_null)``.

    ``status`` is present / missing / extra; ``position`` is the 1-based place
    in the expected layout (extra columns: place in the table after it)."""
    cols = data_columns(df)
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)] or [F.lit(0)])
    extra = [c for c in cols if c not in expected]
    entries = []
    for i, c in enumerate([*expected, *extra]):
        said = c.replace("\\", "\\\\").replace("'", "\\'")
        if c not in cols:
            entries.append(f"'{said}', {i + 1}, 'missing', CAST(NULL AS BIGINT)")
        else:
            entries.append(f"'{said}', {i + 1}, '{'extra' if c in extra else 'present'}', n{cols.index(c)}")
    return row.selectExpr(f"stack({len(entries)}, {', '.join(entries)}) AS (column, position, status, non_null)")


# --- S5 ----------------------------------------------------------------------------------------

def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """``(column, position, rows, non_null, distinct_values)`` per data column.

    ``exact=False`` uses HyperLogLog (``approx_count_distinct``) -- one pass,
    fixed memory -- which is the setting for very large tables."""
    cols = data_columns(df)
    kv = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i + 1).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cols)])
    )
    long = df.select(kv.alias("kv")).select("kv.*")
    distinct = F.count_distinct("value") if exact else F.approx_count_distinct("value")
    return long.groupBy("column", "position").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("non_null"), distinct.alias("distinct_values")
    )


#: Sketches of a profile state: 2^12 registers (distinct counts within about 5 %), quantile ranks within about 1.5 %.
HLL_BITS, KLL_K = 12, 200
FREQUENT = 64


def profile_state(df: DataFrame) -> DataFrame:
    """S5 in parts: a row a data column that can be stored and united with those of other files.

    ``column, position, rows, non_null, distinct_state, length_state, frequent_state``:
    HyperLogLog of the values, KLL of their lengths, and the frequent values, by Spark's
    own sketches.  Of fixed size, whatever the number of rows, and one pass."""
    cols = data_columns(df)
    kv = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i + 1).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cols)])
    long = df.select(F.explode(kv).alias("kv")).select("kv.*")
    return long.groupBy("column", "position").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("non_null"),
        F.hll_sketch_agg("value", HLL_BITS).alias("distinct_state"),
        F.kll_sketch_agg_bigint(F.length("value").cast("long"), KLL_K).alias("length_state"),
        F.call_function("approx_top_k_accumulate", F.col("value"), F.lit(FREQUENT * 16)).alias("frequent_state"),
    )


def merged_profile(states: DataFrame, top: int = 5) -> DataFrame:
    """The profile of all files whose states are given, without their rows:
    ``column, position, rows, non_null, distinct_values, median_length, frequent``.

    Counts are exact; ``frequent`` lists up to ``top`` values with their counts.  Columns
    meet by name (a file that lacks one adds nothing to it); ``position`` is the first."""
    return states.groupBy("column").agg(
        F.min("position").alias("position"),
        F.sum("rows").alias("rows"),
        F.sum("non_null").alias("non_null"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_state")).alias("distinct_values"),
        F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint("length_state"), F.lit(0.5)).alias("median_length"),
        F.call_function("approx_top_k_estimate", F.call_function("approx_top_k_combine", F.col("frequent_state"), F.lit(FREQUENT * 16)), F.lit(top)).alias("frequent"),
    )


# --- S6 ------------------------------------------------------------------------------------------

def preview(df: DataFrame, order_col: str | None = None, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows by position, with flags saying which output columns exist.

    ``orderBy(...).limit(n)`` plans a TakeOrderedAndProject: each task keeps its
    own top ``n``, so only ``n`` rows per task reach the final merge."""
    return (
        df.orderBy(order_col or position_column(df))
        .limit(n)
        .withColumn("has_category", F.lit(CATEGORY_COL in df.columns))
        .withColumn("has_facility", F.lit(FACILITY_COL in df.columns))
        .withColumn("has_description", F.lit(SIMPLE_DESC_COL in df.columns))
    )

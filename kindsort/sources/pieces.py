"""S1 for large files: a CSV file with quoted newlines read by many tasks.

Spark cuts a file into pieces at physical line ends, and a line end may lie inside a
quoted cell.  Whether it does depends on all text before, so three steps find out:

1. every piece is scanned for how it ends (inside a quoted cell or not) for either way of
   entering it: a function of one bit;
2. these functions are composed along each file, one small row a piece, which gives each
   piece its true beginning;
3. every piece is cut into records; what is left over at its ends is put together across
   pieces.

The records then go through Spark's own ``from_csv``.  Only quote characters and commas
are looked at here; cells are not parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces that begin inside a cell are named to every task up to this number; with more, lines are joined with their piece.
SENT = 200_000


def ends_open(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted cell (or at the beginning of a record) ends inside one.

    A cell is quoted if a quote is its first character; a doubled quote stands for one,
    a single one closes the cell, and what follows up to the comma belongs to it."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line[at] == '"':
                at += 1
            else:
                comma = line.find(",", at)
                if comma < 0:
                    return False
                at = comma + 1
                continue
        quote = line.find('"', at)
        while quote >= 0 and line.startswith('"', quote + 1):
            quote = line.find('"', quote + 2)
        if quote < 0:
            return True
        inside = False
        comma = line.find(",", quote + 1)
        if comma < 0:
            return False
        at = comma + 1


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, block, line``: the physical lines of each piece, in their order."""
    read = spark.read.option("lineSep", "\n").text(files)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


_CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+)'
#: A line that begins and ends outside quoted cells: what :func:`ends_open` tells, for Spark's own expressions.
CLOSED = rf"\A{_CELL}(?:,{_CELL})*+\z"


def with_long_records(spark: SparkSession, files: list[str]) -> set[str]:
    """The files in which Spark's line reader would not find the records that a CSV reader finds.

    If no line of a file that begins outside a quoted cell ends inside one, then none
    begins inside one, and every line is a record.  Lines of blanks alone and carriage
    returns within a line are taken otherwise by the line reader, so such files count too."""
    line = F.col("line")
    open_end = F.contains(line, F.lit('"')) & (~F.rlike(line, F.lit(CLOSED)) | F.startswith(line, F.lit('\ufeff"')))
    blanks = F.rlike(line, F.lit(r"\A[\x00-\x20]*[\x00-\x0C\x0E-\x20][\x00-\x20]*\z"))
    returns = F.contains(line, F.lit("\r")) & F.rlike(line, F.lit(r"\r[^\r]"))
    return {r["file"] for r in _lines(spark, files).where(open_end | blanks | returns).select("file").distinct().collect()}


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str], list[bool]]]:
    """Stretches of one piece in a batch: its lines, and which of them hold a quote."""
    files, blocks, lines = (batch.column(c) for c in ("file", "block", "line"))
    quoted = pc.match_substring(lines, '"').to_pylist()
    names, starts, texts = files.to_pylist(), blocks.to_pylist(), lines.to_pylist()
    at = 0
    for i in range(1, len(texts) + 1):
        if i == len(texts) or starts[i] != starts[at] or names[i] != names[at]:
            yield names[at], starts[at], texts[at:i], quoted[at:i]
            at = i


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each piece ends for either beginning: ``out`` (at a record) and ``in`` (inside a quoted cell)."""
    ends: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for file, block, lines, quoted in _runs(batch):
            now = ends.setdefault((file, block), [False, True])
            for line, has in zip(lines, quoted, strict=True):
                if has:
                    now[0] = ends_open(line, now[0])
                    now[1] = ends_open(line, now[1])
    if ends:
        cells = [[k[0] for k in ends], [k[1] for k in ends], [v[0] for v in ends.values()], [v[1] for v in ends.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.string()), pa.array(cells[1], pa.int64()), pa.array(cells[2]), pa.array(cells[3])], names=["file", "block", "out", "in"])


def beginnings(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, block, inside``: whether each piece begins inside a quoted cell.

    A piece that ends alike for both beginnings settles what follows; one that swaps them
    flips it.  So the state before a piece is the last settled one, flipped once for
    every swap since: two running aggregates over one row a piece."""
    ends = _lines(spark, files).mapInArrow(_summarise, "file string, block long, out boolean, in boolean")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("out") & ~F.col("in")).cast("int")).over(before), F.lit(0))
    counted = ends.withColumn("swaps", swaps)
    settled = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").alias("state"), F.col("swaps").alias("at")))
    last = F.last(settled, ignorenulls=True).over(before)
    known = counted.withColumn("last", last)
    flips = F.col("swaps") - F.coalesce(F.col("last.at"), F.lit(0))
    state = F.coalesce(F.col("last.state"), F.lit(False)) != (flips % 2 == 1)
    return known.select("file", "block", state.alias("inside"))


RECORD = "file string, block long, place long, part string, text string"


def _cut(known: set[tuple[str, int]] | None):
    """Records of each piece: ``whole`` ones, the rest of one that began before (``head``) and the beginning of one that goes on (``tail``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, inside, place, head = None, [], False, 0, False
        rows: list[tuple] = []

        def flush(open_end: bool) -> None:
            if held:
                part = "head" if head else "tail" if open_end else "whole"
                rows.append((*piece, piece[1] + place - len(held), part, "\n".join(held)))

        for batch in batches:
            begun = batch.column("inside").to_pylist() if known is None else None
            seen = 0
            for file, block, lines, quoted in _runs(batch):
                if (file, block) != piece:
                    flush(True)
                    piece, held, place = (file, block), [], 0
                    inside = head = begun[seen] if begun is not None else (file, block) in known
                seen += len(lines)
                for line, has in zip(lines, quoted, strict=True):
                    held.append(line)
                    place += 1
                    if has:
                        inside = ends_open(line, inside)
                    if not inside:
                        flush(False)
                        held, head = [], False
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "place", "part", "text"), r, strict=True)) for r in rows], schema=SCHEMA)
                rows.clear()
        flush(True)
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "place", "part", "text"), r, strict=True)) for r in rows], schema=SCHEMA)

    return run


SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("part", pa.string()), ("text", pa.string())])


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, place, text``: every record of the files, header included, with its line breaks.

    ``place`` increases along a file; of a file's first record it is 0."""
    begun = beginnings(spark, files).checkpoint()
    lines = _lines(spark, files)
    inside = begun.where("inside").limit(SENT + 1).collect()
    if len(inside) <= SENT:
        cut = lines.mapInArrow(_cut({(r["file"], r["block"]) for r in inside}), RECORD)
    else:
        numbered = lines.withColumn("number", F.monotonically_increasing_id()).join(begun, ["file", "block"])
        cut = numbered.repartition("file", "block").sortWithinPartitions("file", "block", "number").mapInArrow(_cut(None), RECORD)
    cut = cut.checkpoint()
    # at most two left-over parts a piece: a tail begins a record, heads go on with it
    parts = cut.where("part <> 'whole'").withColumn("order", F.when(F.col("part") == "head", 0).otherwise(1))
    along = Window.partitionBy("file").orderBy("block", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = parts.withColumn("chain", F.sum("order").over(along))
    whole = chained.groupBy("file", "chain").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("block", "order", "text"))).alias("p"))
    joined = whole.select("file", "place", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    every = cut.where("part = 'whole'").select("file", "place", "text").union(joined)
    # where lines end in carriage return and line feed, the pair is one line break, also in a cell
    text = F.when(F.endswith("text", F.lit("\r")), F.replace(F.regexp_replace("text", "\r+$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    return every.select("file", "place", text.alias("text"))


def rows(spark: SparkSession, files: list[str], columns: list[str], raw: str, file: str, place: str, options: dict[str, str]) -> DataFrame:
    """The data rows as Spark parses them: ``columns``, the text of rows that don't fit as ``raw``, ``file`` and ``place``."""
    data = records(spark, files).where((F.col("place") > 0) & (F.col("text") != ""))
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{c} string" for c in [*names, "bad"])
    parsed = data.withColumn("cells", F.from_csv("text", schema, {**options, "columnNameOfCorruptRecord": "bad"}))
    cells = (F.col(f"cells.{n}").alias(c) for n, c in zip([*names, "bad"], [*columns, raw], strict=True))
    return parsed.select(*cells, F.col("file").alias(file), F.col("place").alias(place))

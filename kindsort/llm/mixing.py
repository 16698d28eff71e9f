"""Mixing sources to target weights by capped water-filling.

The words of all sources are shared out by weight.  A source whose share exceeds
``epochs`` times its size is clamped there and the excess goes to the others in
proportion to their weights, until no share exceeds its cap.  A source then gives
each document its whole repetitions, and one more to the documents that come first
in a seeded order, up to the remaining words.  DataFrame functions throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindsort.operators.enrich import with_row_index

from .common import fresh

WORDS = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source in which the last document of the fractional repetition is looked for.
BUCKET_BITS = 12
#: Largest per-source table that is broadcast; a larger one is joined by shuffle, hot sources split by AQE.
BROADCAST_ROWS = 20_000
BIG = "decimal(38,0)"


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place_of(key: Column, seed: str) -> Column:
    """Seeded place of a document in the order of its source: 60 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def ranked_weights(rows: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source and weight of the sources of ``rows``: ``cycle`` repeated along them by code point, null last."""
    sources = rows.select(F.col("source").isNull().alias("last"), "source").distinct()
    ranked = with_row_index(sources, ["last", "source"], name="place")
    at = (F.col("place") % len(cycle)).cast("int")
    return ranked.select("source", F.get(F.array(*map(F.lit, cycle)), at).cast("long").alias("weight"))


@dataclass
class Level:
    """Words a unit of weight, as the exact fraction ``words / weight``."""

    words: int
    weight: int

    def share(self) -> Column:
        return F.lit(str(self.words)).cast(BIG) * F.col("weight")

    def capped(self, epochs: int) -> Column:
        """Whether a source's share exceeds its cap."""
        return F.lit(str(self.weight * epochs)).cast(BIG) * F.col("source_size") < self.share()


def water_level(sources: DataFrame, epochs: int) -> Level:
    """The level of ``sources`` (source_size, weight); two sums a round come to the driver.

    Clamping only ever raises the level, so each round clamps more sources or is the last.
    """
    def sums(where: Column) -> tuple[int, int, int]:
        got = sources.agg(*(F.coalesce(F.sum(F.when(where, x)), F.lit(0)) for x in (F.col("source_size"), F.col("weight"), F.lit(1)))).first()
        return int(got[0]), int(got[1]), int(got[2])

    size, weight, _ = sums(F.lit(True))
    level, clamped = Level(size, max(1, weight)), 0
    while True:
        s, w, n = sums(level.capped(epochs))
        if n == clamped:
            return level
        level, clamped = Level(size - epochs * s, max(1, weight - w)), n


def plan(sizes: DataFrame, weights: DataFrame, epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row a source: ``source, source_size, target, whole, cut, some, many``.

    ``sizes``: key, source, size, mark, read several times (checkpointed).  ``whole``:
    repetitions of every document; ``cut``: the place (hash, key, size, mark) of the last
    documents that have one more.  ``many`` rows share it, and ``some`` of them have it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = totals.alias("t").join(weights.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source"))).select("t.source", "source_size", F.col("weight").cast("long")).checkpoint()
    level = water_level(sources, epochs)
    unit = F.lit(str(level.weight)).cast(BIG)
    whole = F.when(F.col("source_size") == 0, 0)
    for e in range(epochs, 0, -1):
        whole = whole.when(unit * e * F.col("source_size") <= level.share(), e)
    clamped = level.capped(epochs)
    # left: words for the fractional repetition, times the level's weight, an exact integer
    rest = sources.select(
        F.col("source").alias("s"),
        "source_size",
        F.when(clamped, (F.col("source_size") * epochs).cast("double")).otherwise(level.share().cast("double") / unit.cast("double")).alias("target"),
        whole.otherwise(0).cast("long").alias("whole"),
        level.share().alias("share"),
    ).withColumn("left", F.when(F.col("whole") < epochs, F.col("share") - unit * F.col("whole") * F.col("source_size")).otherwise(0).cast(BIG)).drop("share").checkpoint()
    placed = sizes.select("source", F.struct(place_of(F.col("key"), seed).alias("u"), "key", "size", "mark").alias("at"))
    bucket = F.shiftright(F.col("at.u"), 60 - BUCKET_BITS)
    summed = placed.groupBy("source", bucket.alias("bucket")).agg(F.sum("at.size").alias("words"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = summed.withColumn("upto", F.sum("words").over(order))
    edge = running.join(rest.select("s", "left"), F.col("source").eqNullSafe(F.col("s"))).where((unit * F.col("upto") >= F.col("left")) & (unit * (F.col("upto") - F.col("words")) < F.col("left")))
    # one bucket a source: about its places / 4096, and rows that share a place are one
    edge = edge.groupBy("s", "left").agg(F.min("bucket").alias("bucket"), F.min(F.col("upto") - F.col("words")).alias("before"))
    inside = placed.withColumn("b", bucket).join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("bucket")))
    inside = inside.groupBy("s", "at", "left", "before").agg(F.count(F.lit(1)).alias("many"))
    upto = F.sum(F.col("at.size") * F.col("many")).over(Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # twice what is left before this place, times the weight; the i-th of its rows has its middle at (2 i - 1) sizes
    room = (2 * F.col("left") - 2 * unit * (F.col("before") + F.col("upto") - F.col("at.size") * F.col("many"))).cast(BIG)
    step = (unit * F.col("at.size")).cast(BIG)
    some = F.when(F.col("room") <= 0, 0).when((F.col("at.size") == 0) | (F.col("room") > step * (2 * F.col("many") - 1)), F.col("many")).otherwise(F.expr("((room + step - 1) div step) div 2"))
    reached = inside.withColumn("upto", upto).withColumn("room", room).withColumn("step", step).withColumn("some", some.cast("long"))
    last = reached.where("some > 0").groupBy("s").agg(F.max(F.struct("at", "some", "many")).alias("last"))
    # none of the edge bucket: all documents of the buckets before it
    kind = sizes.schema["key"].dataType
    floor = F.struct(F.shiftleft(F.col("bucket"), 60 - BUCKET_BITS).alias("u"), F.lit(None).cast(kind).alias("key"), F.lit(-1).cast("long").alias("size"), F.lit(0).cast("long").alias("mark"))
    cuts = edge.alias("e").join(last.alias("l"), F.col("e.s").eqNullSafe(F.col("l.s")), "left").select(
        F.col("e.s").alias("cs"), F.coalesce(F.col("last.at"), floor).alias("cut"), F.coalesce(F.col("last.some"), F.lit(0)).alias("some"), F.coalesce(F.col("last.many"), F.lit(0)).alias("many")
    )
    out = rest.join(cuts, F.col("s").eqNullSafe(F.col("cs")), "left")
    return out.select(F.col("s").alias("source"), "source_size", "target", "whole", "cut", "some", "many").checkpoint()


def _numbered(rows: DataFrame, source: str, name: str) -> DataFrame:
    """``rows`` with their number (from 0) within their source as ``name``; no source is gathered in a task."""
    mid, pid, count, off = (fresh(rows, f"{name}_{x}") for x in ("mid", "pid", "count", "off"))
    tagged = rows.withColumn(mid, F.monotonically_increasing_id()).checkpoint()
    tagged = tagged.withColumn(pid, F.shiftright(F.col(mid), 33)).withColumn(mid, F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)))
    # a source's rows of one partition are numbered there, as the checkpoint's partitions stay
    order = Window.partitionBy(source, pid).orderBy(mid)
    counts = tagged.groupBy(F.col(source).alias(f"{off}_s"), F.col(pid).alias(f"{off}_p")).agg(F.count(F.lit(1)).alias(count))
    before = F.sum(count).over(Window.partitionBy(f"{off}_s").orderBy(f"{off}_p")) - F.col(count)
    at = counts.withColumn(off, before)
    both = tagged.join(at, F.col(source).eqNullSafe(F.col(f"{off}_s")) & (F.col(pid) == F.col(f"{off}_p")))
    return both.withColumn(name, F.col(off) + F.row_number().over(order) - 1).select(*rows.columns, name)


def mix(documents: DataFrame, weights: DataFrame | None = None, epochs: int = 3, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text", size: str | None = None) -> tuple[DataFrame, str]:
    """``documents`` with one struct column (its name is returned too): ``size``,
    ``source_size``, ``target``, ``repeats`` and ``taken`` (words).

    ``size``: a column that holds the words already, else they are counted in ``text``.
    ``weights``: source, weight (integers above 0); sources without a row take no part
    and come out with null; by default 5, 2, 1 along the sources.  A null source is a
    source; null and empty texts have size 0 and take nothing.  Rows that share key, size
    and text are told apart by number alone where the target ends among them, so the words
    taken are within half a document of it.  Reruns agree.
    """
    names = {}
    for base in ("mix", "mix_size", "mix_source", "mix_by", "mix_at", "mix_repeats", "mix_number"):
        names[base] = fresh(documents, base)
    out, own, mark, by_name, at, repeats, number = names.values()
    words = size_of(F.col(text)) if size is None else F.col(size)
    told = F.coalesce(F.xxhash64(F.col(text)), F.lit(0)) if text in documents.columns else F.lit(0).cast("long")
    sizes = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"), told.alias("mark"))
    sizes = sizes.checkpoint() if size is None else sizes
    by = plan(sizes, ranked_weights(sizes) if weights is None else weights, epochs, seed)
    shared = not by.where("some < many").isEmpty()
    by = by.select(F.col("source").alias(mark), F.struct("source_size", "target", "whole", "cut", "some", "many").alias(by_name))
    by = F.broadcast(by) if by.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else by
    rows = documents.withColumn(own, words).join(by, F.col(source).eqNullSafe(F.col(mark)), "left")
    rows = rows.withColumn(at, F.struct(place_of(F.col(key), seed).alias("u"), F.col(key).alias("key"), F.col(own).alias("size"), told.alias("mark")))
    more = F.col(at) <= F.col(f"{by_name}.cut")
    if shared:
        ends = F.coalesce(F.col(at).eqNullSafe(F.col(f"{by_name}.cut")) & (F.col(f"{by_name}.some") < F.col(f"{by_name}.many")), F.lit(False))
        tied = _numbered(rows.where(ends), source, number)
        rows = rows.where(~ends).withColumn(number, F.lit(-1).cast("long")).unionByName(tied)
        more = more & (F.col(number) < F.col(f"{by_name}.some"))
        more = F.when(F.col(number) < 0, F.col(at) <= F.col(f"{by_name}.cut")).otherwise(more)
    rows = rows.withColumn(repeats, (F.col(f"{by_name}.whole") + F.when(more, 1).otherwise(0)).cast("int"))
    named = F.struct(F.col(own).alias("size"), F.col(f"{by_name}.source_size").alias("source_size"), F.col(f"{by_name}.target").alias("target"), F.col(repeats).alias("repeats"), (F.col(own) * F.col(repeats)).alias("taken"))
    return rows.withColumn(out, named).select(*(F.col(f"`{c}`") for c in documents.columns), out), out


def oracle(cycle: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: str = "mix") -> str:
    """The contract's mix of all documents in DuckDB's SQL; the level comes in closed form from the caps in order."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS u
  FROM documents
),
sources AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         ([{", ".join(map(str, cycle))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(cycle)}]::HUGEINT AS weight
  FROM sized GROUP BY source
),
ordered AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
         sum(source_size) OVER w AS upto_size, sum(weight) OVER w AS upto_weight
  FROM sources WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
),
-- with the k smallest caps clamped, the rest share what is left; the level is the first that clamps no more
levels AS (
  SELECT all_size AS words, all_weight AS weight, 0::HUGEINT AS clamped FROM ordered
  UNION SELECT all_size - {epochs} * upto_size, all_weight - upto_weight, upto_weight FROM ordered WHERE all_weight > upto_weight
),
level AS (
  SELECT words, l.weight FROM levels l WHERE NOT EXISTS (
    SELECT 1 FROM ordered o WHERE o.upto_weight > l.clamped AND {epochs} * o.source_size * l.weight < l.words * o.weight)
  ORDER BY clamped LIMIT 1
),
targets AS (
  SELECT source, source_size, level.weight AS unit, {epochs} * source_size * level.weight < words * sources.weight AS clamped,
         words * sources.weight AS share
  FROM sources, level
),
planned AS (
  SELECT *, CASE WHEN clamped THEN ({epochs} * source_size)::DOUBLE ELSE share::DOUBLE / unit::DOUBLE END AS target,
         CASE WHEN source_size = 0 THEN 0 WHEN clamped THEN {epochs} ELSE least({epochs}, share // (unit * source_size)) END AS whole
  FROM targets
),
placed AS (
  SELECT s.*, p.* EXCLUDE (source), CASE WHEN whole < {epochs} AND source_size > 0 THEN share - whole * unit * p.source_size ELSE 0 END AS left_over,
         sum(size) OVER (PARTITION BY s.source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN unit * (2 * upto - size) < 2 * left_over THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""

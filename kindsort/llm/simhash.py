"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into segments; the vector of their bit counts is its
place on an integer grid.  The Manhattan distance of two places never exceeds the
number of differing bits, so fingerprints within 2 bits are at most 2 steps apart,
and there is a place within one step of both.  Each fingerprint is therefore put in
its own cell and the cells one step away, and only fingerprints that meet in a cell
can link.  With 16 segments of 4 bits a cell seldom holds two fingerprints by
chance: a cell of two is a pair, verified by counting differing bits.  The members
of cells of three or more go to the finest grid, 64 segments of one bit: there the
embedding is exact, a cell holds at most 65 fingerprints which are all linked to
each other, so one chain through a cell stands for all its pairs.  No pairs of a
crowded group are ever listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindsort.session import work_path

from .common import fresh, key_filter, maybe_in

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SEED = 42
#: Shingles hashed at a time: memory of a long text does not grow beyond it.
CHUNK = 65_536
#: Widths in bits of the segments of the coarse grid.
WIDTH = 4


def fingerprint_of(text: str | None, k: int = 3) -> int:
    """64-bit SimHash of the ``k``-word shingles, repeats included; 0 without words."""
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + k - 1]
        shingles = map(" ".join, zip(*(part[j:] for j in range(k)), strict=False)) if len(words) >= k else [" ".join(words)]
        h = np.array([digest(s, SEED) for s in shingles], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, k: int = 3) -> Column:
    """Fingerprint of each text as a signed long; null and empty texts have 0."""

    @F.arrow_udf("long")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(np.fromiter((fingerprint_of(t.as_py(), k) for t in batch), np.uint64, len(batch)).view(np.int64))

    return run.asNondeterministic()(text)


def _cells(fp: Column) -> Column:
    """The cell of a fingerprint and its neighbours one step away, as packed bit counts.

    Each count of 0..4 takes 3 bits of a long, so a step is an addition.
    """
    counts, own = [], F.lit(0).cast("long")
    for i in range(64 // WIDTH):
        count = F.bit_count(F.shiftrightunsigned(fp, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))).cast("long")
        counts.append(count)
        own = own.bitwiseOR(F.shiftleft(count, 3 * i))
    steps = [own]
    for i, count in enumerate(counts):
        one = F.lit(1 << (3 * i)).cast("long")
        steps += [F.when(count < WIDTH, own + one), F.when(count > 0, own - one)]
    return F.array_compact(F.array(*steps))


def _fine_cells(fp: Column) -> Column:
    """The same on the grid of one-bit segments: the fingerprint and its 64 neighbours."""
    return F.array(fp, *(fp.bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long")) for i in range(64)))


def close(a: Column, b: Column, bits: int = 2) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all pairs within 2 bits.

    ``prints``: distinct fingerprints, column ``fp``, cheap to read twice (checkpointed).
    """
    cells = prints.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    met = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1").checkpoint()
    pairs = met.where((F.col("n") == 2) & close(F.col("a"), F.col("b"))).select("a", "b")
    crowded = met.where("n > 2").select("cell")
    # the cells are derived again and met ones let through by a fixed-size filter, so only few rows are joined
    inside = cells.where(maybe_in(key_filter(crowded, "cell"), F.col("cell"))).join(crowded, "cell", "left_semi").select("fp").distinct()
    fine = inside.select("fp", F.explode(_fine_cells(F.col("fp"))).alias("cell"))
    # at most 65 fingerprints lie within a bit of a cell, so the list is bounded
    chains = fine.groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("m")).where(F.size("m") > 1)
    chained = chains.select(F.explode(F.arrays_zip(F.slice("m", 1, F.size("m") - 1).alias("a"), F.expr("slice(m, 2, size(m) - 1)").alias("b"))).alias("e")).select("e.a", "e.b")
    return pairs.union(chained.where(close(F.col("a"), F.col("b")))).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of each component of ``edges`` (a, b).

    Alternating large-star and small-star steps; each step links nodes to the smallest
    neighbour, so the rounds grow with the logarithm of a component's diameter.  The
    edges are checkpointed each round.
    """
    now = edges.select("a", "b").where("a <> b").checkpoint()
    before = None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points down, from a to the smaller b
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = small.where("a <> b").distinct().checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {most} rounds")


def near_duplicates(documents: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``key``, ``fp`` (long), ``root`` (a fingerprint of its group) and ``component_id``.

    Documents link at 2 or fewer differing bits; ``component_id`` is the smallest key
    reachable.  Null and wordless texts have fingerprint 0, which links like any other.
    Repeated rows stay; a null key never names a component unless no other does.
    """
    docs = documents.select(F.col(key).alias("key"), fingerprint(F.col(text), k).alias("fp")).checkpoint()
    prints = docs.groupBy("fp").agg(F.min("key").alias("first")).checkpoint()
    roots = components(links(prints.select("fp"))).checkpoint()
    groups = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    # a root's group may hold many fingerprints, and a fingerprint many documents: plain joins, split by AQE where they are hot
    named = groups.join(named, "root").select("fp", "root", "component_id")
    return docs.join(named, "fp").select(F.col("key").alias(key), "fp", "root", "component_id")


def one_of_each(documents: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each near-duplicate group; every other text stays, whatever keys rows share.

    The rows are written once with their fingerprints, and a row belongs to the group of
    its own fingerprint: of a group the row of the smallest key stays (a null key last;
    then the smallest hash of the text and of all columns).  Only rows of groups of two
    or more are shuffled.
    """
    name = fresh(documents, "fingerprint")
    path = work_path(documents.sparkSession, "fingerprints")
    documents.withColumn(name, fingerprint(F.col(text), k)).write.parquet(path)
    rows = documents.sparkSession.read.parquet(path)
    prints = rows.groupBy(F.col(name).alias("fp")).agg(F.count("*").alias("n")).checkpoint()
    roots = components(links(prints.select("fp")))
    groups = prints.join(roots, prints.fp == roots.node, "left").select("fp", "n", F.coalesce("root", "fp").alias("root")).checkpoint()
    several = groups.groupBy("root").agg(F.sum("n").alias("rows")).where("rows > 1").select("root")
    crowded = groups.join(several, "root").select(F.col("fp").alias(name), F.col("root").alias(f"{name}_root")).checkpoint()
    likely = F.coalesce(maybe_in(key_filter(crowded, name), F.col(name)), F.lit(False))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    place = F.struct(F.col(key).isNull(), F.col(key), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)), F.xxhash64(*columns))
    grouped = rows.where(likely).join(crowded, name)
    kept = grouped.groupBy(f"{name}_root").agg(F.min_by(F.struct(*columns), place).alias("row"))
    alone = rows.where(likely).join(crowded, name, "left_anti").select(*columns)
    return rows.where(~likely).select(*columns).union(alone).union(kept.select(*(F.col("row").getField(c) for c in documents.columns)))

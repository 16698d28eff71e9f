"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindsort.session import ensure_checkpoint_dir, ship_package

#: Bits of a fixed-size membership filter (512 KB, whatever the number of keys).
FILTER_BITS = 1 << 22


def prepare(spark: SparkSession) -> SparkSession:
    """Session ready for an operator: the shared folder is known, the package on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 8 << 20):
    """Within it rows go to Python at most ``rows`` and about ``size`` bytes at a time, for jobs that hold long cells."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def fold_of(key: Column, k: int) -> Column:
    """crc32 of the key as text, modulo ``k``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(k)


def sampled(df: DataFrame, by: str, per_class: int, key: tuple[str, ...] = ("doc_id",), most_classes: int = 200, in_all: int | None = None) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, picked by a hash of ``key``.

    The values of ``by`` are counted first; a row stays if its hash is below its
    class's share, so the sample has about ``per_class`` rows a class at any input
    size, a class of fewer rows stays whole, and a rerun picks the same rows.  The
    ``most_classes`` values with the most rows take part, with ``in_all`` rows together.
    """
    counts = df.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by).limit(most_classes).collect()
    per_class = min(per_class, max(1, in_all // max(1, len(counts)))) if in_all else per_class
    keep = F.lit(False)
    unit = 1 << 31
    for row in sorted(counts, key=lambda r: str(r[0])):
        share = min(unit, max(1, unit * per_class // max(1, row["count"])))
        keep = keep | ((F.col(by) == F.lit(row[0])) & (F.pmod(F.xxhash64(F.lit("sample"), *map(F.col, key)), F.lit(unit)) < F.lit(share)))
    return df.where(keep)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int | None, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) rows to learn from: a bounded sample of labelled documents.

    The labels are sampled before the texts are fetched, so the documents are scanned
    once against at most a few thousand ids (a size set by ``per_class``) and never
    shuffled.  Texts above ``max_chars`` are not learned from (they are scored whole).
    A document with several labels takes the largest, and rows that share an id are one,
    so at most ``4 * per_class`` texts come to the driver.  ``held_out``: the fold that is
    never read; None reads all.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if held_out is not None:
        rows = rows.where(fold_of(F.col("doc_id"), folds) != held_out)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = sampled(rows, "label", per_class).limit(4 * per_class)  # about twice per_class: the limit only makes it sure
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    found = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    got = one_row_each(found, "doc_id").collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))]


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """Of the rows that share ``key`` the one of the smallest hash; combined before the shuffle."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(key).agg(F.min_by(row, F.xxhash64(row)).alias("one_row")).select("one_row.*")


def key_filter(keys: DataFrame, key: str) -> Column:
    """A fixed-size bit set of the column ``key``, as a scalar subquery for ``maybe_in``.

    Two bits a key in ``FILTER_BITS`` bits, so its size never depends on the number of
    keys; with many keys it only lets more through.  What passes must be joined exactly.
    """
    words = FILTER_BITS // 64
    bits = keys.select(F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    some = bits.select(F.expr("bit div 64").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
    every = some.union(keys.sparkSession.range(words).select("id", F.lit(0).cast("long")))
    whole = every.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return whole.select(F.transform("w", lambda w: w["bits"]).alias("words")).scalar()


def maybe_in(words: Column, key: Column) -> Column:
    """True for each key of the filter, and for a few others."""
    one, two = (
        F.call_function("shiftright", F.get(words, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        for bit in _bits(key)
    )
    return one & two


def _bits(key: Column) -> tuple[Column, Column]:
    """The two bits of a key: two parts of one hash."""
    width, h = FILTER_BITS.bit_length() - 1, F.xxhash64(key)
    mask = F.lit(FILTER_BITS - 1).cast("long")
    return h.bitwiseAND(mask), F.shiftrightunsigned(h, width).bitwiseAND(mask)


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not among ``keys``; null keys stay.

    Rows that the filter clears pass without a shuffle; only the others are joined.
    """
    dropped = keys.select(key).where(F.col(key).isNotNull()).distinct().checkpoint()
    known = key_filter(dropped, key)
    likely = F.coalesce(maybe_in(known, F.col(key)), F.lit(False))
    return rows.where(~likely).union(rows.where(likely).join(dropped, key, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns)))


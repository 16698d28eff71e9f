"""Importance resampling towards a target distribution, with prefix-CRC n-grams.

A document is scanned once: its words, joined by single spaces, go through CRC-32 and the
running value at each word's end is stored with the word's length.  The CRC of any run of
words then follows from two of these prefixes: appending n bytes multiplies what a prefix
left by x^(8n) over GF(2), so ``crc(run) = crc(up to its end) ^ shift(crc(before it), n)``.
The stored prefixes serve both passes, the one that counts the features of the corpus and
the one that weighs each document by them; the texts are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindsort.operators.enrich import with_row_index
from kindsort.session import work_path

from .common import prepare, small_batches

#: Words held at a time by a task; a longer document is held by itself.
HELD = 1 << 18
#: Rows of prefixes that a task sends on at a time, in words.
SENT = 1 << 17
#: Bytes of a row group of the stored prefixes: what a task that writes them holds.
GROUP = 16 << 20


def _word_bytes() -> bytes:
    """Digits, a-z and all bytes of letters beyond ASCII stay, A-Z become a-z, the rest separates."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


WORD_BYTES = _word_bytes()


def prefixes_of(text: bytes | None) -> tuple[list[int], list[int]]:
    """The running CRC at the end of each word, and the words' lengths in bytes."""
    words = (text or b"").translate(WORD_BYTES).split()
    ends, crc = [], 0
    for w in words:
        crc = crc32(w, crc)
        ends.append(crc)
        crc = crc32(b" ", crc)
    return ends, [len(w) for w in words]


class Shifts:
    """Multiplication of CRCs by x^(8n) over GF(2): tables for each power of two in n."""

    def __init__(self, polynomial: int = 0xEDB88320):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, step >> 1 ^ np.uint32(polynomial), step >> 1)
        self.step = step
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.tables = [self._table(bits >> 8 ^ step[bits & 255])]
        for _ in range(31):
            last = self.tables[-1]
            self.tables.append(self._table(self._apply(last, self._apply(last, bits))))

    @staticmethod
    def _table(images: np.ndarray) -> np.ndarray:
        """From the images of single bits, those of the values of each of the four bytes."""
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte, np.arange(256) >> bit & 1 == 1] ^= images[8 * byte + bit]
        return out

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def shift(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each CRC as it would be after ``n`` more zero bytes, without the bytes."""
        out = crc.copy()
        for b in range(int(n.max(initial=0)).bit_length()):
            some = np.flatnonzero(n >> b & 1)
            out[some] = self._apply(self.tables[b], out[some])
        return out

    def spaced(self, crc: np.ndarray) -> np.ndarray:
        """Each CRC with one space appended."""
        z = ~crc
        return ~(z >> 8 ^ self.step[(z ^ np.uint32(32)) & 255])


SHIFTS = Shifts()


def run_crcs(ends: np.ndarray, lengths: np.ndarray, first: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, CRCs) of the runs of 1 to ``longest`` words, by their first word.

    ``first``: for each word whether it is the first of its document."""
    n = len(ends)
    before = np.zeros(n, np.uint32)
    before[1:] = SHIFTS.spaced(ends[:-1])
    before[first] = 0
    document = np.cumsum(first)
    upto = np.cumsum(lengths)
    for words in range(1, longest + 1):
        at = np.arange(max(0, n - words + 1))
        last = at + words - 1
        same = document[at] == document[last]
        at, last = at[same], last[same]
        size = upto[last] - upto[at] + lengths[at] + words - 1
        yield at, ends[last] ^ SHIFTS.shift(before[at], size)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, start, held = batch.column("text").cast(pa.binary()), 0, 0
        ends, lengths = [], []
        for i in range(batch.num_rows):
            e, n = prefixes_of(texts[i].as_py())
            ends.append(np.array(e, np.uint32).view(np.int32))
            lengths.append(np.array(n, np.int32))
            held += len(e)
            if held >= SENT or i + 1 == batch.num_rows:
                cells = [batch.column("key").slice(start, i + 1 - start), *(pa.ListArray.from_arrays(_offsets(x), np.concatenate(x)) for x in (ends, lengths))]
                yield pa.RecordBatch.from_arrays(cells, names=["key", "ends", "lengths"])
                start, held, ends, lengths = i + 1, 0, [], []


def _offsets(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]), pa.int32())


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words of each, ends, lengths) of at most ``HELD`` words, or of one document."""
    for batch in batches:
        sizes = np.asarray(batch.column("ends").value_lengths())
        start = 0
        while start < batch.num_rows:
            upto = np.cumsum(sizes[start:])
            n = max(1, int(np.searchsorted(upto, HELD, "right")))
            part = batch.slice(start, n)
            ends, lengths = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ends", "lengths"))
            yield part, sizes[start : start + n], ends.view(np.uint32), lengths.astype(np.int64)
            start += n


def _features(sizes: np.ndarray, ends: np.ndarray, lengths: np.ndarray, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every feature, a run length at a time."""
    first = np.zeros(len(ends), bool)
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = True
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at, crc in run_crcs(ends, lengths, first, longest):
        yield owner[at], (crc % np.uint32(buckets)).astype(np.int64)


def prefixes(df: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``key, ends, lengths`` of each row, written once to the shared folder."""
    spark = prepare(df.sparkSession)
    rows = df.select((F.lit(0) if key is None else F.col(key)).alias("key"), F.col(text).alias("text"))
    path = work_path(spark, "prefixes")
    type_of = rows.schema["key"].dataType.simpleString()
    rows.mapInArrow(_scan, f"key {type_of}, ends array<int>, lengths array<int>").write.option("parquet.block.size", GROUP).parquet(path)
    return spark.read.parquet(path)


def bucket_counts(stored: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``bucket, n``: features of all stored documents; at most ``buckets`` rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, sizes, ends, lengths in _documents(batches):
            for _, bucket in _features(sizes, ends, lengths, buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    return stored.select("ends", "lengths").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain``: floor(1000 ln of the smoothed ratio target / raw) for every bucket."""
    total = F.struct(*(F.coalesce(x.agg(F.sum("n")).scalar(), F.lit(0)).cast("double").alias(c) for c, x in (("t", target), ("s", raw))))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), total.alias("total"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    ratio = (t + 1) * (F.col("total.s") + buckets) / ((s + 1) * (F.col("total.t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(stored: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """``key, n_words, n_features, weight``: the floored mean gain of each document's features (none: 0)."""
    type_of = stored.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sizes, ends, lengths in _documents(batches):
            n, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for owner, bucket in _features(sizes, ends, lengths, len(gain), longest):
                n += np.bincount(owner, minlength=len(sizes))
                total += np.bincount(owner, weights=gain[bucket], minlength=len(sizes)).astype(np.int64)  # whole numbers below 2^53
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            cells = [part.column("key"), *(pa.array(x.astype(np.int64)) for x in (sizes, n, weight))]
            yield pa.RecordBatch.from_arrays(cells, names=["key", "n_words", "n_features", "weight"])

    return stored.mapInArrow(run, f"key {type_of}, n_words long, n_features long, weight long")


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, longest: int = 2, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every document.

    Words are runs of digits, a-z (A-Z are lowered) and characters beyond ASCII; features
    are the runs of 1 to ``longest`` words, repeats included, hashed to ``buckets`` by
    their CRC-32.  ``score`` adds Gumbel noise, seeded by the key, to the weight; the
    ``percent`` of the documents with ``least_words`` words that have the highest scores
    are drawn, ``rank`` counts them from 1 (ties: smaller key, a null key last; null for
    the others).  Null and wordless texts have weight 0 and no feature.  Rows that repeat a key are
    documents of their own that share their noise; a null key's noise is that of the word
    ``null``.  Only the table of ``buckets`` gains passes through the driver.
    """
    with small_batches(documents.sparkSession):
        stored = prefixes(documents, key, text)
        raw, goal = (bucket_counts(x, buckets, longest).checkpoint() for x in (stored, prefixes(target, None, text)))
        gain = np.array([r["gain"] for r in gains(raw, goal, buckets).orderBy("bucket").collect()], np.int64)
        weighed = weights(stored, gain, longest).checkpoint()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", F.col("weight") + noise)
    # equal rows are told apart, so that a key on very many of them is split over tasks
    long = scored.where(F.col("n_words") >= least_words).withColumns({"down": -F.col("score"), "unnamed": F.col("key").isNull(), "tie": F.monotonically_increasing_id()})
    placed = with_row_index(long, ["down", "unnamed", "key", "n_features", "tie"], name="place")
    drawn = percent * placed.count() // 100
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    ranked = placed.select(*scored.columns, rank.alias("rank"))
    return ranked.union(short).withColumnRenamed("key", key)


def oracle(percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> str:
    """The same draw in DuckDB's SQL; CRC-32 byte by byte over each distinct feature."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH step AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
b AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
fd AS MATERIALIZED (
  SELECT row, unnest(w) AS f FROM d UNION ALL
  SELECT row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
),
fb AS MATERIALIZED (
  SELECT unnest(w) AS f FROM b UNION ALL
  SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b
),
bytes AS (
  SELECT f, list_transform(range(len(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS x
  FROM (SELECT f FROM fd UNION SELECT f FROM fb)
),
bucketed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {buckets} AS bucket
  FROM bytes, step
),
raw AS (SELECT bucket, count(*) AS s FROM fd JOIN bucketed USING (f) GROUP BY bucket),
goal AS (SELECT bucket, count(*) AS t FROM fb JOIN bucketed USING (f) GROUP BY bucket),
gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM fd) + {buckets})::DOUBLE
         / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM fb) + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({buckets})) AS bucket) LEFT JOIN raw USING (bucket) LEFT JOIN goal USING (bucket)
),
weighed AS (
  SELECT row, count(*) AS n, sum(gain)::BIGINT AS total FROM fd JOIN bucketed USING (f) JOIN gain USING (bucket) GROUP BY row
),
scored AS (
  SELECT row, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
         coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN weighed USING (row)
),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
         count(*) OVER (PARTITION BY n_words >= {least_words}) AS many
  FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {least_words} AND place <= {percent} * many // 100 THEN place END::BIGINT AS rank
FROM ranked"""

"""Benchmark decontamination by spaced seeds.

A mask such as ``110111`` reads the words under its ones and ignores those under its
zeros, so a passage whose ignored words were replaced still has the same hash.  Test and
training texts are hashed at every word position under each mask; equal hashes give an
alignment (document position minus item position), and around it the aligned words are
compared, so that replaced words cost only themselves.  The masks are found by a search
that ends when every pattern of replaced words which the rule allows is hit, so nothing
that meets the rule is missed.  DataFrame functions throughout.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, key_filter, maybe_in, without

#: An overlap is WINDOW aligned words (the whole item if shorter) of which SHARE are equal.
WINDOW, SHARE = 13, 0.75
#: Masks for items of one length; fewer words under a mask need fewer masks, but meet more often by chance.
MASKS = 4
#: Patterns of replaced words that are enumerated; with more, one mask of adjacent words is taken.
PATTERNS = 20_000


def needed(words: int, share: float) -> int:
    """Equal words that an overlap of so many words needs."""
    return ceil(share * words)


@cache
def covering_masks(words: int, equal: int, most: int = MASKS) -> tuple[str, ...]:
    """At most ``most`` masks of as many words as possible, one of which fits wherever ``equal`` of ``words`` words are equal.

    A greedy cover of all patterns of ``words - equal`` replaced words.  The last resort is
    one mask of adjacent words: some run of equal words is that long in any pattern."""
    differ = words - equal
    if comb(words, differ) <= PATTERNS:
        patterns = [sum(1 << p for p in c) for c in combinations(range(words), differ)]
        for weight in range(equal, 1, -1):
            if comb(words - 1, weight - 1) > PATTERNS:
                continue
            found = _cover(words, weight, patterns, most)
            if found:
                return found
    return ("1" * max(1, -(-equal // (differ + 1))),)


def _cover(words: int, weight: int, patterns: list[int], most: int) -> tuple[str, ...] | None:
    masks = [(span, 1 | 1 << (span - 1) | sum(1 << p for p in inner)) for span in range(weight, words + 1) for inner in combinations(range(1, span - 1), weight - 2)]
    hit = {(span, m): {i for i, bad in enumerate(patterns) if any(not m << o & bad for o in range(words - span + 1))} for span, m in masks}
    left, out = set(range(len(patterns))), []
    while left and len(out) < most:
        span, m = max(masks, key=lambda x: (len(hit[x] & left), -x[0], -x[1]))
        left -= hit[span, m]
        out.append("".join("1" if m >> i & 1 else "0" for i in range(span)))
    return None if left else tuple(out)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased letter and digit runs of a text; null: none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(masks: list[str], wanted: dict[str, Column] | None = None) -> Column:
    """The hashes of the words under each mask from ``at`` on, null past the end of ``w`` (and where a mask is not wanted)."""
    size = F.size("w")
    each = []
    for m in masks:
        fits = F.col("at") + len(m) <= size
        fits = fits & wanted[m] if wanted else fits
        each.append(F.when(fits, F.xxhash64(F.lit(m), *(F.get(F.col("w"), F.col("at") + j) for j, c in enumerate(m) if c == "1"))))
    return F.explode(F.array(*each))


def _places(rows: DataFrame, masks: list[str]) -> DataFrame:
    least = min(map(len, masks))
    return rows.where(F.size("w") >= least).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - least)))


#: Equal words of the best window over a list of shifts, by a running sum: add the word that enters, drop the one that leaves.
BEST = (
    "array_max(transform(shifts, shift -> named_struct("
    "'equal', aggregate(sequence(0, size(iw) - 1), struct(0 as now, 0 as best),"
    " (s, j) -> struct(s.now + if(get(dw, j + shift) <=> iw[j], 1, 0) - if(j >= of, if(get(dw, j + shift - of) <=> get(iw, j - of), 1, 0), 0) as now,"
    " greatest(s.best, s.now + if(get(dw, j + shift) <=> iw[j], 1, 0) - if(j >= of, if(get(dw, j + shift - of) <=> get(iw, j - of), 1, 0), 0)) as best), s -> s.best),"
    " 'back', -shift, 'of', of)))"
)


def overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, most_masks: int = MASKS, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each document and item that overlap: ``key``, ``item``, ``equal`` words
    of the best window of ``of`` aligned words, and ``doc_word``, the place of its item's first word.

    The rule: of ``window`` adjacent words of the item (the whole item if shorter) at
    least ``share`` stand at the same places in the document.  Every such overlap is
    found.  Rows with a null key are not searched (no result could name them); null and
    wordless texts and items overlap with nothing; repeated rows give one result.
    """
    docs = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.unhex(F.sha2(F.col(text), 256)).alias("digest"))
    found = text_overlaps(documents.where(F.col(key).isNotNull()).select(F.col(text).alias("text")), benchmark, window, share, most_masks, item, text)
    hit = docs.where(maybe_in(key_filter(found, "digest"), F.col("digest"))).join(found, "digest")
    top = hit.groupBy("doc", "item").agg(F.max("best").alias("t"))
    return top.select(F.col("doc").alias(key), F.col("item").alias(item), F.col("t.equal").alias("equal"), F.col("t.of").alias("of"), (-F.col("t.back")).alias("doc_word"))


def text_overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, most_masks: int = MASKS, item: str = "item_id", text: str = "text") -> DataFrame:
    """``digest, item, best`` (a struct) of each *text* (column ``text`` of ``documents``) and item that overlap; copies count once.

    A text is known by its sha256.  Its seeds pass a fixed-size bit set of the items'
    seeds before anything is shuffled; the shifts at which a text meets an item are
    gathered (no more than the words of both), and the words of the text join once.
    """
    texts = documents.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").where("digest is not null")
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), word_hashes(F.col(text)).alias("w")).where(F.size("w") > 0).distinct()
    # rows of one item that differ in their text are items of their own here
    items = items.withColumn("version", F.xxhash64("w")).checkpoint()
    length = F.least(F.lit(window), F.size("w"))
    # at most ``window`` lengths, each with its own masks
    by_length = {n: covering_masks(n, needed(n, share), most_masks) for (n,) in items.select(length).distinct().collect()}
    masks = sorted({m for every in by_length.values() for m in every}) or ["1"]
    wanted = {m: length.isin([n for n, every in by_length.items() if m in every]) for m in masks}
    sown = _places(items, masks).select("item", "version", "at", _seeds(masks, wanted).alias("h")).where("h is not null").checkpoint()
    known = key_filter(sown, "h")

    # one row a place and mask before the filter: each step is small enough to be compiled
    places = _places(texts.select("digest", word_hashes(F.col("text")).alias("w")), masks)
    hashed = places.select("digest", F.col("at").alias("doc_at"), _seeds(masks).alias("h"))
    found = hashed.where(F.col("h").isNotNull() & maybe_in(known, F.col("h")))
    shift = (F.col("doc_at") - F.col("at")).alias("shift")
    met = found.join(sown, "h").select("digest", "item", "version", shift).distinct()
    aligned = met.groupBy("digest", "item", "version").agg(F.collect_list("shift").alias("shifts")).checkpoint()

    likely = texts.where(maybe_in(key_filter(aligned, "digest"), F.col("digest")))
    back = likely.dropDuplicates(["digest"]).select("digest", word_hashes(F.col("text")).alias("dw"))
    both = aligned.join(items.withColumnRenamed("w", "iw"), ["item", "version"]).join(back, "digest").withColumn("of", F.least(F.lit(window), F.size("iw")))
    checked = both.select("digest", "item", F.expr(BEST).alias("best")).where(F.col("best.equal") >= F.ceil(F.lit(share) * F.col("best.of")))
    return checked.groupBy("digest", "item").agg(F.max("best").alias("best")).checkpoint()


def uncontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """``documents`` without the rows whose text overlaps with an item, whatever keys rows have; null texts stay."""
    name = fresh(documents, "digest")
    gone = text_overlaps(documents.select(F.col(text).alias("text")), benchmark, text=text, **kw).select(F.col("digest").alias(name))
    return without(documents.withColumn(name, F.unhex(F.sha2(F.col(text), 256))), gone, name).drop(name)


def oracle(window: int = WINDOW, share: float = SHARE) -> str:
    """The rule itself in DuckDB's SQL: every alignment with an equal word, without seeds or hashes."""
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS MATERIALIZED (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT doc_id, w AS text_words, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d),
bw AS (SELECT item_id, w AS item_words, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM b),
aligned AS (
  SELECT doc_id, item_id, text_words, item_words, dw.pos - bw.pos AS shift FROM dw JOIN bw USING (x)
  GROUP BY ALL HAVING count(*) >= ceil({share} * least({window}, len(item_words)))
),
same AS (
  SELECT doc_id, item_id, shift, least({window}, len(item_words)) AS of,
         list_transform(item_words, lambda x, j: CASE WHEN j + shift >= 1 AND text_words[j + shift] = x THEN 1 ELSE 0 END) AS m
  FROM aligned
),
best AS (SELECT doc_id, item_id, shift, of, list_max(list_transform(range(1, len(m) - of + 2), lambda i: list_sum(m[i : i + of - 1])))::INT AS equal FROM same),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal DESC, shift, of DESC) AS k FROM best WHERE equal >= ceil({share} * of))
SELECT doc_id, item_id, equal, of::INT AS of, shift::INT AS doc_word FROM top WHERE k = 1"""

"""Rules held in a table, matched by an inverted index of each keyword's rarest gram.

A text can only contain a keyword if it contains every gram of it, so each keyword is
filed under one gram: the one that fewest texts have, as a pass over the texts counts
them.  A keyword with a gram that no text has is dropped at once.  The texts send on only
the grams that some keyword is filed under (told by a bit set of fixed size), these meet
the index in an equi-join, and ``contains`` decides.  Neither rules nor texts come to the
driver, no task holds all rules, and everything runs in the JVM.

A gram has 6 characters, 3 for keywords below 6 and 2 or 1 for still shorter ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of grams; a keyword uses the longest that it has.
SIZES = (6, 3, 2, 1)
#: Bits of the set of filed grams (512 KB, whatever the number of rules).
BITS = 1 << 22


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _grams(chars: Column, size: int) -> Column:
    """The grams of one length, as an array; linear in the text (characters are split off once)."""
    places = F.sequence(F.lit(0), F.size(chars) - size)
    each = F.transform(places, lambda i: F.concat(*(F.get(chars, i + k) for k in range(size))))
    return F.when(F.size(chars) >= size, each).otherwise(F.array().cast("array<string>"))


def _gram_size(keyword: Column) -> Column:
    return F.coalesce(*(F.when(F.length(keyword) >= s, F.lit(s)) for s in SIZES))


def _bit_of(gram: Column) -> tuple[Column, Column]:
    width, mask = BITS.bit_length() - 1, F.lit(BITS - 1).cast("long")
    h = F.xxhash64(gram)
    return h.bitwiseAND(mask), F.shiftrightunsigned(h, width).bitwiseAND(mask)


def _bit_set(grams: DataFrame) -> Column:
    """A set of the column ``gram`` in ``BITS`` bits, two a gram, as a scalar subquery."""
    bits = grams.select(F.explode(F.array(*_bit_of(F.col("gram")))).alias("bit"))
    some = bits.select(F.expr("bit div 64").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
    every = some.union(grams.sparkSession.range(BITS // 64).select("id", F.lit(0).cast("long")))
    words = every.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return words.select(F.transform("w", lambda w: w["bits"]).alias("words")).scalar()


def _maybe(words: Column, gram: Column) -> Column:
    """True for each gram of the set, and for a few others."""
    def has(bit: Column) -> Column:
        word = F.get(words, F.shiftright(bit, 6).cast("int"))
        return F.call_function("shiftright", word, bit.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    one, two = map(has, _bit_of(gram))
    return one & two


def _text_grams(texts: DataFrame, sizes: list[int], filed: Column, keep: list[str]) -> DataFrame:
    """The distinct grams of each text that may be in the set, a row each."""
    with_chars = texts.where(F.col("text").isNotNull()).withColumn("chars", _chars(F.col("text")))
    every = F.concat(*(_grams(F.col("chars"), s) for s in sizes))
    grams = with_chars.select(*keep, F.explode(F.array_distinct(every)).alias("gram"))
    return grams.where(_maybe(filed, F.col("gram")))


def rarest_grams(texts: DataFrame, rules: DataFrame, sizes: list[int]) -> DataFrame:
    """``rules`` whose keyword all grams of which occur in ``texts``, with the rarest as ``gram``."""
    size = _gram_size(F.col("keyword"))
    of_size = F.coalesce(*(F.when(size == s, _grams(_chars(F.col("keyword")), s)) for s in sizes))
    wanted = rules.select("keyword", F.explode(F.array_distinct(of_size)).alias("gram"))
    known = _text_grams(texts, sizes, _bit_set(wanted), []).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = wanted.join(known, "gram", "left").groupBy("keyword").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("least")
    )
    return rules.join(ranked.where("least > 0").drop("least"), "keyword")


def hits(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``id`` of the texts with each rule whose keyword they contain (all columns of ``rules``).

    ``texts``: ``id, text``; ``rules``: ``keyword`` and any other columns, one row a
    keyword.  Both are read more than once (checkpointed).  A null text contains nothing,
    an empty or null keyword is in none."""
    rules = rules.where("keyword <> ''")
    # at most one row a gram length
    sizes = sorted(r[0] for r in rules.select(_gram_size(F.col("keyword"))).distinct().collect())
    if not sizes:
        return texts.where(F.lit(False)).select("id", *(F.lit(None).cast(rules.schema[c].dataType).alias(c) for c in rules.columns))
    index = rarest_grams(texts, rules, sizes).checkpoint()
    found = _text_grams(texts, sizes, _bit_set(index.select("gram").distinct()), ["id", "text"]).join(index, "gram")
    return found.where(F.contains("text", "keyword")).select("id", *rules.columns)


def numbered(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), ``id`` and ``text`` of each row, written once so that the ids stay."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.monotonically_increasing_id().alias("id"), F.col(f"`{text}`").alias("text")).checkpoint()


def first_match_by_table(df: DataFrame, key: str, text_lc: str, rules: DataFrame, rule_set: str = "category") -> DataFrame:
    """Ordered first match through a rule table: ``(key, priority, keyword, label)``, a row each row of ``df``.

    ``rules``: ``rule_set, priority, keyword, label``; a keyword that repeats keeps its
    first place.  Null values where nothing matches, and for a null text."""
    r = rules.where(F.col("rule_set") == rule_set).groupBy("keyword").agg(F.min("priority").alias("priority"), F.min_by("label", "priority").alias("label")).checkpoint()
    rows = numbered(df, text_lc, [key])
    rule = F.struct("priority", "keyword", "label")
    best = hits(rows.select("id", "text"), r).groupBy("id").agg(F.min(rule).alias("m"))
    return rows.join(best, "id", "left").select(f"row.`{key}`", "m.priority", "m.keyword", "m.label")


def labels_by_table(df: DataFrame, text_lc: str, rules: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the sorted comma list of the labels whose keywords the text contains (any match), null for none.

    ``rules``: ``keyword, label``; keywords are lowered, and one may have several labels."""
    r = rules.select(F.lower("keyword").alias("keyword"), "label").where("label is not null").groupBy("keyword").agg(F.collect_set("label").alias("labels")).checkpoint()
    columns = [c for c in df.columns if c != out]
    rows = numbered(df, text_lc, columns)
    found = hits(rows.select("id", "text"), r).select("id", F.explode("labels").alias("label"))
    # of one text at most as many as there are labels
    told = found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("told"))
    return rows.join(told, "id", "left").select("row.*", F.col("told").alias(out))


def any_by_table(df: DataFrame, text_lc: str, rules: DataFrame, out: str) -> DataFrame:
    """C5 with ``df``'s columns: whether the text contains any ``keyword`` of the table (null for a null text)."""
    r = rules.select("keyword").distinct().checkpoint()
    columns = [c for c in df.columns if c != out]
    rows = numbered(df, text_lc, columns)
    found = hits(rows.select("id", "text"), r).select("id").distinct().withColumn("told", F.lit(True))
    flag = F.when(F.col("text").isNotNull(), F.coalesce("told", F.lit(False)))
    return rows.join(found, "id", "left").select("row.*", flag.alias(out))

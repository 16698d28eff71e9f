"""Property: the one-pass automaton equals the literal contains chain on any text."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindsort.functions.matcher import match_columns
from kindsort.functions.vocab import CATEGORY_RULES, DISTRICT_KEYWORDS, REVIEW_KEYWORDS, RURAL_KEYWORDS

WORDS = [k for k, _ in CATEGORY_RULES] + RURAL_KEYWORDS + DISTRICT_KEYWORDS + REVIEW_KEYWORDS
# fragments that overlap keywords: whole words, prefixes, suffixes, noise
PIECES = st.one_of(
    st.sampled_from(WORDS),
    st.sampled_from(WORDS).map(lambda w: w[: max(1, len(w) // 2)]),
    st.sampled_from(WORDS).map(lambda w: w[len(w) // 2 :]),
    st.text(alphabet="abcdeilmnorstxy -,é", max_size=6),
)
TEXTS = st.lists(st.lists(PIECES, max_size=8).map("".join) | st.none(), min_size=1, max_size=40)

ORDERED = {"category": CATEGORY_RULES}
UNORDERED = {"review": REVIEW_KEYWORDS, "rural": RURAL_KEYWORDS, "district": DISTRICT_KEYWORDS}


@settings(max_examples=15, deadline=None)
@given(texts=TEXTS)
def test_automaton_equals_columns(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cols = match_columns(F.col("t"), ORDERED, UNORDERED, engine="columns")
    a = df.select("i", *[cols[k].alias(k) for k in ["category", "review", "rural", "district"]])
    s = match_columns(F.col("t"), ORDERED, UNORDERED, engine="automaton")["__struct__"]
    b = df.select("i", s.alias("m")).select("i", "m.category", "m.review", "m.rural", "m.district")
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)

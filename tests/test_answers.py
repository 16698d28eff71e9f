"""Answer normalisation (P8-P10), requests and answers."""

from pyspark.sql import functions as F

from conftest import inventory
from kindsort.functions.text import clean_description, normalize_label, normalize_yes_no
from kindsort.functions.vocab import CATEGORY_COL, CATEGORY_LABELS, FACILITY_COL, FACILITY_LABELS, SIMPLE_DESC_COL
from kindsort.operators import enrich as L
from kindsort.operators.classify import categorize, describe, facility, request_id

NR = "Needs Review"
PPE = "PPE & Infection Control"

# answer -> (as category, as facility)
ANSWER_MATRIX = [
    ("Rural Clinics", NR, "Rural Clinics"),
    ("3. Both Settings", NR, "Both"),
    ("both rural clinics and district hospitals", NR, "Rural Clinics"),
    ("Category: Both", NR, "Both"),
    ("Both: any setting", NR, NR),
    ("x: y: Both", NR, NR),
    (" \tDistrict Hospitals\n", NR, "District Hospitals"),
    ("\u00a0Both\u00a0", NR, "Both"),
    (":Both", NR, "Both"),
    ("Answer:", NR, NR),
    ("1. PPE & Infection Control", PPE, NR),
    ("ppe & infection control", PPE, NR),
    ("PPE and Infection Control", NR, NR),
    ("", NR, NR),
    (None, NR, NR),
]


def py_normalize(answer, labels):
    """Plain-Python statement of the label clean-up, for cross-checking."""
    if answer is None:
        return NR
    r = answer.strip()
    if ":" in r:
        r = r.split(":")[1].strip()
    if r in labels:
        return r
    for lab in labels:
        if lab.lower() in r.lower():
            return lab
    return NR


def test_answer_matrix(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in ANSWER_MATRIX], "a string")
    out = df.select(
        "a",
        normalize_label(F.col("a"), CATEGORY_LABELS).alias("c"),
        normalize_label(F.col("a"), FACILITY_LABELS).alias("f"),
    ).collect()
    got = {r.a: (r.c, r.f) for r in out}
    for a, c, f in ANSWER_MATRIX:
        assert got[a] == (c, f), repr(a)
        assert py_normalize(a, CATEGORY_LABELS) == c and py_normalize(a, FACILITY_LABELS) == f


def test_python_whitespace_is_stripped(spark):
    odd = "\x1c\x1f \u3000\x85"
    df = spark.createDataFrame([(odd + "Both" + odd,)], "a string")
    assert df.select(normalize_label(F.col("a"), FACILITY_LABELS)).first()[0] == "Both"
    assert (odd + "Both" + odd).strip() == "Both"


def test_yes_no(spark):
    cases = [("yes", "Yes"), (" YES ", "Yes"), ("No", "No"), ("maybe", "No"), ("Yes.", "No"), (None, NR)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "a string")
    got = {r[0]: r[1] for r in df.select("a", normalize_yes_no(F.col("a"))).collect()}
    assert got == dict(cases)


def test_clean_description(spark):
    cases = [('"Gauze pad"', "Gauze pad"), (" 'x' ", "x"), ("it's", "it's"), ("''\"", "")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "a string")
    got = {r[0]: r[1] for r in df.select("a", clean_description(F.col("a"))).collect()}
    assert got == dict(cases)
    for a, b in cases:
        assert a.strip().strip("\"'") == b


def _attempts(spark, rows):
    return spark.createDataFrame(rows, L.ATTEMPT_SCHEMA)


def test_attempt_matrix(spark):
    rows = [
        ("r1", 1, False, None, "e1", None), ("r1", 2, True, "ok2", None, 5), ("r1", 3, True, "ok3", None, 7),
        ("r2", 1, False, None, "e1", None), ("r2", 2, False, None, "e2", None), ("r2", 3, False, None, "e3", None),
        ("r2", 4, True, "ok4", None, 9),
        ("r3", 1, True, "x", None, 3),
        ("r4", 1, True, None, None, 2), ("r4", 2, True, ' "fine" ', None, 4),
    ]
    res = {r.request_id: r for r in L.resolve_attempts(_attempts(spark, rows)).collect()}
    assert res["r1"].description == "ok2" and res["r1"].ok_attempt == 2 and res["r1"].responses == 1 and res["r1"].tokens == 5
    assert res["r2"].description == "Error generating description: e3" and res["r2"].responses == 0
    assert res["r3"].description == "x"
    # a response without text is counted in the usage and then retried
    assert res["r4"].description == "fine" and res["r4"].responses == 2 and res["r4"].tokens == 6
    u = L.usage(L.resolve_attempts(_attempts(spark, rows))).first()
    assert u.total_requests == 4 and u.total_tokens == 14 and abs(u.est_cost - 14 / 1000 * 0.002) < 1e-15


def test_unfinished_attempts_stay_open(spark):
    rows = [
        ("r1", 1, False, None, "e1", None),
        ("r2", 1, False, None, "e1", None), ("r2", 2, False, None, "e2", None), ("r2", 3, True, None, None, 4),
        ("r3", 2, True, "ok", None, 1),
        # the log repeats attempts: one counts, the one with a response first
        ("r4", 1, True, "b", None, 2), ("r4", 1, True, "a", None, 9), ("r4", 1, False, None, "e", None), ("r4", 1, None, None, None, None),
    ]
    res = L.resolve_attempts(_attempts(spark, rows * 3))
    got = {r.request_id: r for r in res.collect()}
    assert got["r1"].description is None and got["r1"].attempts == 1
    assert got["r2"].description == "Error generating description: 'NoneType' object has no attribute 'strip'" and got["r2"].tokens == 4
    assert (got["r4"].description, got["r4"].attempts, got["r4"].responses, got["r4"].tokens) == ("b", 1, 1, 2)
    assert {r[0] for r in L.finished(res).collect()} == {"r2", "r3", "r4"}


def test_several_answers_to_a_request_keep_the_rows(spark):
    df = inventory(spark, [("spare bracket", "Acme", None)] * 3)
    rid = L.requests(categorize(df, trace=True), "category").first().request_id
    frid = L.requests(facility(categorize(df), trace=True), "facility").first().request_id
    ans = spark.createDataFrame([(rid, "Diagnostics & Lab Use"), (rid, PPE), (rid, None), (None, "x"), (frid, "Both"), (frid, "Both")], L.COMPLETION_SCHEMA)
    out = categorize(df, completions=ans).collect()
    assert [r[CATEGORY_COL] for r in out] == [PPE] * 3
    assert [r[FACILITY_COL] for r in facility(categorize(df), completions=ans).collect()] == ["Both"] * 3
    late = ans.withColumn("batch_id", F.when(F.col("response").startswith("Diag"), 2).otherwise(1))
    assert [r[CATEGORY_COL] for r in categorize(df, completions=late).collect()] == ["Diagnostics & Lab Use"] * 3


def test_request_texts(spark):
    """The request texts, word for word."""
    df = spark.createDataFrame([("odd thing", "Acme", "Cat", "Sub", "PC")], "DESCRIPTION string, VENDOR_NAME string, CATEGORY string, SUBCATEGORY string, `Product Category` string")
    one = lambda t, stage: L.requests(t, stage).first().context
    assert one(categorize(df, preserve_existing=False, trace=True), "category") == "Description: odd thing, Vendor: Acme, Subcategory: Sub"
    assert one(facility(df, trace=True), "facility") == "Description: odd thing, Category: PC, Vendor: Acme"
    assert one(describe(df, trace=True), "description") == (
        "Write a one-line, plain-language description of this medical inventory item for a reader without medical training."
        "\n\nItem: odd thing\nVendor: Acme\nCategory: Cat\nSubcategory: Sub\n\n"
        "Keep it under 15 words, say what the item is and what it is for, use short common abbreviations and standard units, "
        "leave out brand names unless needed, and reply with the description only."
    )


def test_requests_and_answers_round_trip(spark):
    rows = [("spare bracket", "Acme", "Misc"), ("spare bracket", "Acme", "Misc"), ("exam table", None, None), ("", None, None)]
    df = inventory(spark, rows)
    traced = categorize(df, trace=True)
    reqs = L.requests(traced, "category")
    assert reqs.count() == 2
    r = reqs.first()
    assert r.context == "Description: spare bracket, Vendor: Acme, Subcategory: Misc"
    assert (r.max_tokens, r.temperature, r.stage) == (30, 0.0, "category")
    pend = L.pending(reqs)
    assert pend.count() == 1
    done = spark.createDataFrame([(r.request_id, " 1. PPE & Infection Control ")], L.COMPLETION_SCHEMA)
    assert L.pending(reqs, done).count() == 0
    out = {(x.DESCRIPTION, x[CATEGORY_COL]) for x in categorize(df, completions=done).collect()}
    assert ("spare bracket", PPE) in out and ("exam table", "Medical Equipment & Furniture") in out


def test_facility_context_uses_category(spark):
    df = inventory(spark, [("spare bracket", "Acme", None)])
    cat = categorize(df)
    reqs = L.requests(facility(cat, trace=True), "facility").collect()
    assert reqs[0].context == "Description: spare bracket, Category: Needs Review, Vendor: Acme"
    assert reqs[0].request_id == spark.range(1).select(request_id("facility", F.lit(reqs[0].context))).first()[0]


def test_description_blank_and_subset(spark):
    rows = [(i, f"item {i}" if i % 4 else "", "old") for i in range(10)]
    df = spark.createDataFrame(rows, "KEY long, DESCRIPTION string, SIMPLE_DESCRIPTION string")
    df = L.first_rows(df, ["KEY"], 6)
    reqs = L.requests(describe(df, first_n=6, trace=True), "description")
    # rows 0..5 minus the blank ones (0 and 4)
    assert reqs.count() == 4
    att = reqs.select("request_id", F.lit(1).alias("attempt"), F.lit(True).alias("responded"),
                      F.concat(F.lit("'"), F.col("request_id").substr(1, 4), F.lit("'")).alias("response"),
                      F.lit(None).cast("string").alias("error"), F.lit(10).cast("long").alias("total_tokens"))
    out = {r.KEY: r[SIMPLE_DESC_COL] for r in describe(df, L.resolve_attempts(att), first_n=6).collect()}
    assert out[0] == "No description available" and out[4] == "No description available"
    assert all(out[k] == "old" for k in range(6, 10))
    assert all(len(out[k]) == 4 for k in (1, 2, 3, 5))


def test_row_index_matches_row_number(spark):
    from pyspark.sql import Window

    df = spark.range(0, 5000, 3).withColumnRenamed("id", "k").repartition(7)
    a = L.with_row_index(df, ["k"], partitions=5)
    b = df.withColumn("_row", F.row_number().over(Window.orderBy("k")) - 1)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_row_index_with_payload_and_sampled_bounds(spark):
    """More rows per input partition than the range sampler keeps, plus a
    payload column: the counts must come from the same partition cut as the rows."""
    from pyspark.sql import Window

    df = (
        spark.range(0, 200000, 3)
        .withColumnRenamed("id", "k")
        .withColumn("payload", F.concat(F.lit("x"), F.col("k").cast("string")))
        .repartition(7)
    )
    a = L.with_row_index(df, ["k"], partitions=5)
    b = df.withColumn("_row", F.row_number().over(Window.orderBy("k")) - 1)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_completer_hook(spark):
    import pandas as pd

    reqs = L.requests(categorize(inventory(spark, [("spare bracket", None, None), ("foam cushion", None, None)]), trace=True), "category")

    def answer(pdf: pd.DataFrame) -> pd.Series:
        return pdf["context"].str.upper()

    got = L.complete_with(reqs, answer, partitions=2).collect()
    assert sorted(r.response for r in got) == ["DESCRIPTION: FOAM CUSHION", "DESCRIPTION: SPARE BRACKET"]


def test_hot_context_on_a_third_of_rows(spark):
    """One description on a third of all rows: one request, answered on every row."""
    hot = [("spare bracket", "Acme", None)] * 300
    cold = [(f"foam cushion {i}", None, None) for i in range(300)] + [(f"glove {i}", None, None) for i in range(300)]
    df = inventory(spark, hot + cold).repartition(8)
    traced = categorize(df, trace=True)
    reqs = L.requests(traced, "category")
    pend = L.pending(reqs)
    assert pend.count() == 301
    hot_id = pend.filter(F.col("context").startswith("Description: spare")).first().request_id
    done = spark.createDataFrame([(hot_id, "Medical Equipment & Furniture")], L.COMPLETION_SCHEMA)
    out = categorize(df, completions=done).groupBy(CATEGORY_COL).count()
    got = {r[0]: r[1] for r in out.collect()}
    assert got == {"Medical Equipment & Furniture": 300, "Needs Review": 300, "Medical & Surgical Supplies": 300}

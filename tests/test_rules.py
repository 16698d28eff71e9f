"""Truth tables of the rule classifiers (phrase matrix, unit rows, Q-rows)."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import inventory
from kindsort.functions.matcher import first_match_by_table
from kindsort.functions.rules import rule_rows, rules_table
from kindsort.functions.vocab import CATEGORY_COL, FACILITY_COL, DISTRICT_KEYWORDS, RURAL_KEYWORDS
from kindsort.operators.classify import categorize, electricity, facility
from kindsort.sources.testview import PHRASES

EQ = "Medical Equipment & Furniture"
SU = "Medical & Surgical Supplies"
PPE = "PPE & Infection Control"
CL = "Cleaning & Facility Maintenance"
DX = "Diagnostics & Lab Use"
NR = "Needs Review"
RC, DH, BO = "Rural Clinics", "District Hospitals", "Both"

# phrase -> (category, facility) with no subcategory and no answers
PHRASE_MATRIX = [
    ("exam table", EQ, NR),
    ("nitrile glove", SU, RC),
    ("face mask", PPE, RC),
    ("bleach wipe", CL, NR),
    ("rapid test kit", DX, RC),
    ("patient monitor", EQ, DH),
    ("syringe pump", SU, BO),
    ("expired catheter", SU, NR),
    ("autoclave", NR, BO),
    ("x-ray film", NR, DH),
    ("aspirin tablet", EQ, RC),
    ("label printer", DX, NR),
    ("stopper, rubber", PPE, NR),
    ("bandage dressing", SU, RC),
    ("advanced widget", NR, NR),
    ("spare bracket", NR, NR),
    ("oxygen concentrator", NR, BO),
    ("foam cushion", NR, NR),
]

FACILITY_SOURCE = {
    "exam table": "residual", "bleach wipe": "residual", "label printer": "residual",
    "stopper, rubber": "residual", "spare bracket": "residual", "foam cushion": "residual",
    "expired catheter": "review", "advanced widget": "review",
}


def classify(spark, rows):
    df = inventory(spark, rows)
    return {r.DESCRIPTION: r for r in facility(categorize(df, trace=True), trace=True).collect()}


def test_vocabulary_sizes():
    assert Counter(r[0] for r in rule_rows()) == {"category": 46, "rural": 82, "district": 89, "review": 23}
    assert len(set(RURAL_KEYWORDS)) == 81 and len(set(DISTRICT_KEYWORDS)) == 84


def test_phrase_matrix(spark):
    assert [p for p, _, _ in PHRASE_MATRIX] == PHRASES
    got = classify(spark, [(p, "Vendor", None) for p, _, _ in PHRASE_MATRIX])
    for phrase, cat, fac in PHRASE_MATRIX:
        r = got[phrase]
        assert r[CATEGORY_COL] == cat, phrase
        assert r[FACILITY_COL] == fac, phrase
        assert r._fac_src == FACILITY_SOURCE.get(phrase, "rule"), phrase


def test_unit_rows(spark):
    rows = [(None, None, None), ("", None, None), (" ", None, None), ("GLOVE", None, None),
            ("Surface label", None, None), ("Gentle soap", None, None), ("Adolescent crutch", None, None)]
    df = facility(categorize(inventory(spark, rows), trace=True), trace=True).collect()
    got = {r.DESCRIPTION: r for r in df}
    assert got[None][CATEGORY_COL] == "Uncategorized" and got[None][FACILITY_COL] == NR
    assert got[""][CATEGORY_COL] == "Uncategorized" and got[""]._cat_src == "blank"
    assert got[" "]._cat_src == "residual" and got[" "][CATEGORY_COL] == NR and got[" "]._fac_src == "residual"
    assert got["GLOVE"][CATEGORY_COL] == SU and got["GLOVE"][FACILITY_COL] == RC
    assert got["Surface label"][CATEGORY_COL] == PPE
    assert got["Gentle soap"][CATEGORY_COL] == CL and got["Gentle soap"][FACILITY_COL] == DH
    assert got["Adolescent crutch"][FACILITY_COL] == BO


def test_subcategory_hint_only_after_description(spark):
    rows = [("spare bracket", None, "Lab goods"), ("exam table", None, "Lab goods"), ("spare bracket", None, ""),
            ("", None, "Lab goods")]
    got = facility(categorize(inventory(spark, rows), trace=True)).collect()
    res = [(r.DESCRIPTION, r.SUBCATEGORY, r[CATEGORY_COL], r._cat_src) for r in got]
    assert ("spare bracket", "Lab goods", DX, "subcategory") in res
    assert ("exam table", "Lab goods", EQ, "description") in res
    assert ("spare bracket", "", NR, "residual") in res
    assert ("", "Lab goods", "Uncategorized", "blank") in res


def test_review_prefix_forces_review(spark):
    rows = [("expired " + p, None, None) for p, _, _ in PHRASE_MATRIX]
    got = facility(categorize(inventory(spark, rows))).collect()
    assert {r[FACILITY_COL] for r in got} == {NR}


def test_case_does_not_matter(spark):
    lo = classify(spark, [(p.lower(), None, None) for p, _, _ in PHRASE_MATRIX])
    up = classify(spark, [(p.upper(), None, None) for p, _, _ in PHRASE_MATRIX])
    for p, _, _ in PHRASE_MATRIX:
        assert lo[p.lower()][CATEGORY_COL] == up[p.upper()][CATEGORY_COL]
        assert lo[p.lower()][FACILITY_COL] == up[p.upper()][FACILITY_COL]


def test_preserve_existing(spark):
    rows = [("exam table", None, None, "Custom"), ("exam table", None, None, " "), ("exam table", None, None, ""),
            ("exam table", None, None, None)]
    df = inventory(spark, rows, ("DESCRIPTION", "VENDOR_NAME", "SUBCATEGORY", CATEGORY_COL))
    kept = [r[CATEGORY_COL] for r in categorize(df, preserve_existing=True).collect()]
    assert sorted(kept, key=str) == sorted(["Custom", " ", EQ, EQ], key=str)
    cleared = {r[CATEGORY_COL] for r in categorize(df, preserve_existing=False).collect()}
    assert cleared == {EQ}
    once = categorize(df, preserve_existing=True)
    twice = categorize(once, preserve_existing=True)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_facility_is_always_recomputed(spark):
    df = inventory(spark, [("syringe pump", None, None, "stale")], ("DESCRIPTION", "VENDOR_NAME", "SUBCATEGORY", FACILITY_COL))
    assert facility(df).first()[FACILITY_COL] == BO


def test_missing_description_column_is_blank(spark):
    df = spark.createDataFrame([("x",)], "VENDOR_NAME string")
    r = facility(categorize(df)).first()
    assert r[CATEGORY_COL] == "Uncategorized" and r[FACILITY_COL] == NR


def test_electricity(spark):
    rows = [(None, None, None), ("patient monitor", None, None), ("foam cushion", None, None)]
    got = {r.DESCRIPTION: r["Requires Electricity"] for r in electricity(inventory(spark, rows), ["Monitor"]).collect()}
    assert got == {None: NR, "patient monitor": "Yes", "foam cushion": NR}
    with pytest.raises(ValueError):
        electricity(inventory(spark, rows), [])


def test_literal_and_table_forms_agree(spark):
    from kindsort.operators.classify import keyword_category
    from kindsort.sources.testview import part_inventory

    df = part_inventory(spark, "/root/testdata/sf0.001")
    lit = keyword_category(df).select("KEY", "keyword", "label")
    tab = first_match_by_table(df.withColumn("_d", F.lower("DESCRIPTION")), "KEY", "_d", rules_table(spark)).select(
        "KEY", "keyword", "label"
    )
    assert lit.exceptAll(tab).count() == 0 and tab.exceptAll(lit).count() == 0


def test_repartition_changes_nothing(spark):
    from kindsort.sources.testview import lineitem_inventory

    df = lineitem_inventory(spark, "/root/testdata/sf0.001")
    a = facility(categorize(df)).groupBy(CATEGORY_COL, FACILITY_COL).count()
    b = facility(categorize(df.repartition(13))).groupBy(CATEGORY_COL, FACILITY_COL).count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_expected_counts_sf0001(spark):
    from kindsort.sources.testview import lineitem_inventory

    df = facility(categorize(lineitem_inventory(spark, "/root/testdata/sf0.001")))
    cats = {r[0]: r[1] for r in df.groupBy(CATEGORY_COL).count().collect()}
    facs = {r[0]: r[1] for r in df.groupBy(FACILITY_COL).count().collect()}
    assert cats == {EQ: 1382, SU: 1349, NR: 1113, DX: 1104, PPE: 614, CL: 296, "Uncategorized": 142}
    assert facs == {NR: 2745, RC: 1671, BO: 946, DH: 638}


@pytest.mark.parametrize("source", ["lineitem", "documents"])
def test_engines_agree(spark, source):
    from kindsort.sources.testview import document_inventory, lineitem_inventory

    load = lineitem_inventory if source == "lineitem" else document_inventory
    df = load(spark, "/root/testdata/sf0.001")
    cols = ["ITEM_NO", "_cat_kw", "_fac_review", "_fac_rural", "_fac_district", CATEGORY_COL, FACILITY_COL]
    a = facility(categorize(df, trace=True, engine="columns"), trace=True, engine="columns").select(cols)
    b = facility(categorize(df, trace=True, engine="automaton"), trace=True, engine="automaton").select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_shuffled_facility_lists_change_nothing(spark):
    import random

    from kindsort.functions.matcher import match_columns
    from kindsort.functions.vocab import REVIEW_KEYWORDS
    from kindsort.sources.testview import lineitem_inventory

    df = lineitem_inventory(spark, "/root/testdata/sf0.001").select(F.lower("DESCRIPTION").alias("t"))
    rnd = random.Random(7)
    lists = {"review": REVIEW_KEYWORDS, "rural": RURAL_KEYWORDS, "district": DISTRICT_KEYWORDS}
    shuffled = {k: rnd.sample(v, len(v)) for k, v in lists.items()}
    for engine in ("columns", "automaton"):
        a = match_columns(F.col("t"), {}, lists, engine)
        b = match_columns(F.col("t"), {}, shuffled, engine)
        if "__struct__" in a:
            a = {k: a["__struct__"][k] for k in lists}
            b = {k: b["__struct__"][k] for k in lists}
        x = df.select(*[a[k].alias(k) for k in lists])
        y = df.select(*[b[k].alias(k) for k in lists])
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_rule_table_first_match(spark):
    words = [("category", i, w, f"L{i}") for i, w in enumerate(["pump", "syringe pump", "rare", "é", "pump", "", "glove"])]
    rules = spark.createDataFrame(words, "rule_set string, priority int, keyword string, label string")
    texts = [(1, "a syringe pump"), (2, "glove é"), (3, "none"), (4, None), (5, ""), (1, "a rare glove")]
    df = spark.createDataFrame(texts, "k int, t string")
    want = sorted([(1, 0, "pump", "L0"), (2, 3, "é", "L3"), (3, None, None, None), (4, None, None, None), (5, None, None, None), (1, 2, "rare", "L2")], key=str)
    out = first_match_by_table(df, "k", "t", rules)
    assert sorted(map(tuple, out.collect()), key=str) == want
    none = first_match_by_table(df, "k", "t", rules.limit(0))
    assert {r[1] for r in none.collect()} == {None}

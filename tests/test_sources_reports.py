"""CSV source and sinks (S1-S7, K1-K4), reports (A*, G*), pipeline and stream (W*)."""

import csv
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kindsort.functions.vocab import CATEGORY_COL, CATEGORY_LABELS, FACILITY_COL, FACILITY_LABELS, SIMPLE_DESC_COL
from kindsort.operators import report as R
from kindsort.operators.classify import categorize, facility
from kindsort.plans.batch import CLI_DEFAULTS, FORM_DEFAULTS, Options, build, run
from kindsort.sources import inventory as S

HEADER = "ITEM_NO,DESCRIPTION,VENDOR_NAME,SUBCATEGORY,COST,EXTRA\n"
BODY = (
    '00123,"Nitrile glove, large",Acme,NA,1.5,x\n'
    '00124,"Exam ""table"" with\nsecond line",None,,2,y\n'
    '00125,  face mask  ,"",null,N/A,z\n'
    '00126,,Acme,Lab goods,abc,w\n'
)


def scratch():
    return tempfile.mkdtemp(prefix="kindsort-test-", dir="/tmp")


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_read(spark):
    d = scratch()
    p = write(os.path.join(d, "inv.csv"), HEADER + BODY)
    df = S.read_inventory_csv(spark, p)
    rows = df.orderBy(S.position_column(df)).collect()
    assert [r.ITEM_NO for r in rows] == ["00123", "00124", "00125", "00126"]
    assert rows[0].DESCRIPTION == "Nitrile glove, large" and rows[0].SUBCATEGORY is None
    assert rows[1].DESCRIPTION == 'Exam "table" with\nsecond line' and rows[1].VENDOR_NAME is None
    assert rows[2].DESCRIPTION == "  face mask  " and rows[2].VENDOR_NAME is None and rows[2].COST is None
    # cells stay as they are; parsed measures are asked for
    assert rows[3].DESCRIPTION is None and rows[3].COST == "abc"
    assert rows[0].COST == "1.5" and rows[0].EXTRA == "x"
    parsed = S.read_inventory_csv(spark, p, measures=True).collect()
    assert sorted((r.COST for r in parsed), key=str) == [1.5, 2.0, None, None]
    out = {r.ITEM_NO: r[CATEGORY_COL] for r in categorize(df).collect()}
    assert out == {"00123": "Medical & Surgical Supplies", "00124": "Medical Equipment & Furniture",
                   "00125": "PPE & Infection Control", "00126": "Uncategorized"}


def test_folder_of_layouts_loads_by_name(spark):
    d = scratch()
    write(os.path.join(d, "a.csv"), "ITEM_NO,DESCRIPTION,VENDOR_NAME\n1,glove,A\n")
    write(os.path.join(d, "b.csv"), "VENDOR_NAME,ITEM_NO,DESCRIPTION\nBeta,2,mask\n")
    write(os.path.join(d, "c.csv"), "ITEM_NO,DESCRIPTION,VENDOR_NAME,_note\n3,\"two\nlines\",C,n\n")
    write(os.path.join(d, "d.csv"), "ITEM_NO,DESCRIPTION,VENDOR_NAME\n")
    df = S.read_inventory_csv(spark, d)
    assert S.data_columns(df) == ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "_note"]
    got = {(r.ITEM_NO, r.DESCRIPTION, r.VENDOR_NAME, r._note) for r in df.collect()}
    assert got == {("1", "glove", "A", None), ("2", "mask", "Beta", None), ("3", "two\nlines", "C", "n")}
    write(os.path.join(d, "e.csv"), "ITEM_NO,DESCRIPTION\n4,x\n")
    with pytest.raises(ValueError, match="Missing required columns: VENDOR_NAME"):
        S.read_inventory_csv(spark, d)


def test_surplus_fields_are_rejected_visibly(spark):
    d = scratch()
    body = '1,tray,Acme\n2,tray, sterile mask,Acme\n3,short\n4,"a ""b"", c",Acme\n5,x,y,\n6,"m,\nn",Z,"q\nr",s\n'
    p = write(os.path.join(d, "inv.csv"), "ITEM_NO,DESCRIPTION,VENDOR_NAME\n" + body)
    df = S.read_inventory_csv(spark, p)
    got = {r.ITEM_NO: (r.DESCRIPTION, r.VENDOR_NAME) for r in df.collect()}
    assert got == {"1": ("tray", "Acme"), "3": ("short", None), "4": ('a "b", c', "Acme")}
    bad = S.read_rejects(spark, p).collect()
    assert sorted(r.raw[0] for r in bad) == ["2", "5", "6"] and {r.reason for r in bad} == {"more than 3 fields"}


def test_single_line_files_are_split(spark):
    d = scratch()
    p = write(os.path.join(d, "inv.csv"), "ITEM_NO,DESCRIPTION,VENDOR_NAME\n" + "1,glove,Acme\n" * 60_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        whole, parts = (S.read_inventory_csv(spark, p, multi_line=m) for m in (True, False))
        assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() >= 4
        assert parts.count() == 60_000 and parts.select(S.position_column(parts)).distinct().count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_reordered_header_loads_by_name(spark):
    d = scratch()
    write(os.path.join(d, "a.csv"), "ITEM_NO,DESCRIPTION,VENDOR_NAME\n1,glove,A\n")
    write(os.path.join(d, "b.csv"), "VENDOR_NAME,ITEM_NO,DESCRIPTION\nB,2,mask\n")
    got = {r.ITEM_NO: (r.DESCRIPTION, r.VENDOR_NAME) for r in S.read_inventory_csv(spark, os.path.join(d, "a.csv")).collect()}
    got.update({r.ITEM_NO: (r.DESCRIPTION, r.VENDOR_NAME) for r in S.read_inventory_csv(spark, os.path.join(d, "b.csv")).collect()})
    assert got == {"1": ("glove", "A"), "2": ("mask", "B")}


def test_required_columns(spark):
    d = scratch()
    p = write(os.path.join(d, "bad.csv"), "ITEM_NO,DESCRIPTION\n1,glove\n")
    with pytest.raises(ValueError, match="Missing required columns: VENDOR_NAME"):
        S.read_inventory_csv(spark, p)
    df = S.read_inventory_csv(spark, p, validate=False)
    t = {r.column: (r.present, r.blank_rows) for r in S.required_columns_table(df).collect()}
    assert t == {"ITEM_NO": (True, 0), "DESCRIPTION": (True, 0), "VENDOR_NAME": (False, None)}


def test_schema_drift_and_profile(spark):
    d = scratch()
    p = write(os.path.join(d, "inv.csv"), HEADER + BODY)
    df = S.read_inventory_csv(spark, p)
    drift = {r.column: (r.status, r.non_null) for r in S.schema_drift(df).collect()}
    assert drift["ITEM_NO"] == ("present", 4) and drift["DIST_NO"] == ("missing", None) and drift["EXTRA"] == ("extra", 4)
    prof = {r.column: (r.rows, r.non_null, r.distinct_values) for r in S.profile(df).collect()}
    assert prof["VENDOR_NAME"] == (4, 2, 1) and prof["ITEM_NO"] == (4, 4, 4)


def test_csv_write_round_trip(spark):
    from kindsort.sinks import write_csv

    d = scratch()
    p = write(os.path.join(d, "inv.csv"), HEADER + BODY)
    df = S.read_inventory_csv(spark, p)
    out = os.path.join(d, "out")
    write_csv(df, out)
    back = S.read_inventory_csv(spark, out)
    assert S.data_columns(back) == S.data_columns(df)
    cols = ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "SUBCATEGORY", "COST", "EXTRA"]
    assert back.select(cols).exceptAll(df.select(cols)).count() == 0
    assert df.select(cols).exceptAll(back.select(cols)).count() == 0


def test_reports(spark):
    from conftest import inventory

    rows = [("glove", None, None)] * 3 + [("mask", None, None)] * 2 + [("bracket", None, None), (None, None, None)]
    res = facility(categorize(inventory(spark, rows)))
    dist = R.ordered(R.distribution(res, CATEGORY_COL)).collect()
    assert [(r.label, r["count"]) for r in dist][:2] == [("Medical & Surgical Supplies", 3), ("PPE & Infection Control", 2)]
    assert abs(dist[0].pct - 3 / 7 * 100) < 1e-12
    ct = {r.label: (r["Rural Clinics"], r["Both"], r["Needs Review"]) for r in R.crosstab(res).collect()}
    assert ct["Medical & Surgical Supplies"] == (3, 0, 0) and ct["Uncategorized"] == (0, 0, 1)
    dl = R.distinct_labels(res).first()
    assert (dl.categories, dl.facility_types) == (4, 2)


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "KEY")
    a = [r.KEY for r in R.sample(df, "KEY", 7).collect()]
    b = [r.KEY for r in R.sample(df.repartition(5), "KEY", 7).collect()]
    assert len(a) == 10 and sorted(a) == sorted(b)
    assert R.sample(df.limit(3), "KEY").count() == 3


def test_pipeline_options(spark):
    from conftest import inventory

    df = inventory(spark, [("glove", "A", None), ("bracket", None, None)])
    full = build(df, CLI_DEFAULTS)
    assert {CATEGORY_COL, FACILITY_COL, SIMPLE_DESC_COL} <= set(full.columns)
    form = build(df, FORM_DEFAULTS)
    assert CATEGORY_COL in form.columns and FACILITY_COL not in form.columns and SIMPLE_DESC_COL not in form.columns
    assert not [c for c in full.columns if c.startswith("_")]


def test_run_end_to_end(spark):
    d = scratch()
    p = write(os.path.join(d, "inv.csv"), HEADER + BODY)
    rec = run(spark, p, os.path.join(d, "out"), Options(skip_descriptions=True))
    stages = [r.stage for r in rec.to_df().collect()]
    assert stages == ["classify", "rejects", "csv", "requests", "report"]
    lines = text_lines(os.path.join(d, "out", "summary"))
    assert lines[0] == "Inventory classification" and lines[2] == f"Input: {p}" and lines[3] == f"Output: {d}/out"
    assert [x.split(":")[0] for x in lines[4:7]] == ["Started", "Seconds", "Total items processed"] and lines[6] == "Total items processed: 4"
    # literal report: headings, then counts (ties by label), then the cross-tab
    assert lines[7:] == [
        "", "Items by product category", "-------------------------",
        "Medical & Surgical Supplies: 1 (25.0%)", "Medical Equipment & Furniture: 1 (25.0%)", "PPE & Infection Control: 1 (25.0%)", "Uncategorized: 1 (25.0%)",
        "", "Items by facility suitability", "-----------------------------",
        "Needs Review: 2 (50.0%)", "Rural Clinics: 2 (50.0%)",
        "", "Product category by facility suitability", "----------------------------------------",
        "Medical & Surgical Supplies: Rural Clinics=1, District Hospitals=0, Both=0, Needs Review=0",
        "Medical Equipment & Furniture: Rural Clinics=0, District Hospitals=0, Both=0, Needs Review=1",
        "PPE & Infection Control: Rural Clinics=1, District Hospitals=0, Both=0, Needs Review=0",
        "Uncategorized: Rural Clinics=0, District Hospitals=0, Both=0, Needs Review=1",
    ]
    csv_cols = spark.read.options(header=True).csv(os.path.join(d, "out", "csv")).columns
    assert csv_cols == ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME", "SUBCATEGORY", "COST", "EXTRA", CATEGORY_COL, FACILITY_COL]
    assert rec.progress["classify"] == {"rows": 4, "category_residual": 0, "facility_residual": 1}


def text_lines(folder):
    """Lines of a text table in the order of its part files."""
    return [x for f in sorted(glob.glob(os.path.join(folder, "part-*"))) for x in open(f).read().splitlines()]


def test_run_keeps_every_column_and_cell(spark):
    d = scratch()
    head = "ITEM_NO,DESCRIPTION,VENDOR_NAME,_note,_cat_id,_cat_src,_pos,_file,_d,_match,COST,QTY"
    rows = [f'{i},glove {i},Acme,n{i},c{i},s{i},p{i},f{i},d{i},m{i},"$1,234.50",12 EA' for i in range(50)]
    p = write(os.path.join(d, "inv.csv"), "\n".join([head, *rows, "99,a,b,c,d,e,f,g,h,i,j,k,surplus"]) + "\n")
    rec = run(spark, p, os.path.join(d, "out"), Options(description_batch=5))
    assert {r[1]: r[3] for r in rec.rows}["rejects"] == 1
    files = sorted(glob.glob(os.path.join(d, "out", "csv", "part-*.csv")))
    got = [r for f in files for r in list(csv.reader(open(f)))[1:]]
    names = next(csv.reader(open(files[0])))
    assert names == [*head.split(","), CATEGORY_COL, FACILITY_COL, SIMPLE_DESC_COL]
    # in input order, cell for cell
    assert [r[:12] for r in got] == [next(csv.reader([x])) for x in rows]
    reqs = spark.read.parquet(os.path.join(d, "out", "requests"))
    assert reqs.where("stage = 'description'").count() == 5


def test_a_folder_comes_out_in_the_order_of_its_files(spark):
    d = scratch()
    os.makedirs(os.path.join(d, "in"))
    for name, n in (("b", 3), ("a", 40), ("c", 2)):
        extra = ",more" if name == "a" else ""
        write(os.path.join(d, "in", f"{name}.csv"), f"ITEM_NO,DESCRIPTION,VENDOR_NAME{extra and ',EXTRA'}\n" + "".join(f"{name}{i:02d},odd thing,V{extra}\n" for i in range(n)))
    for _ in range(2):
        run(spark, os.path.join(d, "in"), os.path.join(d, "out"), Options(skip_facility=True, description_batch=41))
    files = sorted(glob.glob(os.path.join(d, "out", "csv", "part-*.csv")))
    got = [r[0] for f in files for r in list(csv.reader(open(f)))[1:]]
    assert got == [f"{name}{i:02d}" for name, n in (("a", 40), ("b", 3), ("c", 2)) for i in range(n)]
    table = spark.read.parquet(os.path.join(d, "out", "table"))
    assert {r.ITEM_NO for r in table.where("_trace._desc_src <> 'skipped'").collect()} == {f"a{i:02d}" for i in range(40)} | {"b00"}
    record = spark.read.parquet(os.path.join(d, "out", "run_record"))
    assert record.select("run_id").distinct().count() == 2 and record.where("stage = 'classify' and rows = 45").count() == 2


def test_requests_come_in_batches_with_their_kinds(spark):
    d = scratch()
    p = write(os.path.join(d, "inv.csv"), "ITEM_NO,DESCRIPTION,VENDOR_NAME\n" + "".join(f"{i},odd thing {i},A\n" for i in range(23)))
    run(spark, p, os.path.join(d, "out"), Options(skip_facility=True, skip_descriptions=True, batch_size=10))
    sizes = spark.read.parquet(os.path.join(d, "out", "requests")).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in sizes] == [(0, 10), (1, 10), (2, 3)]
    kinds = {r.stage: r for r in spark.read.parquet(os.path.join(d, "out", "request_kinds")).collect()}
    assert kinds["category"].labels == CATEGORY_LABELS and kinds["facility"].labels == FACILITY_LABELS
    assert kinds["description"].labels is None and kinds["electricity"].labels == ["Yes", "No"]
    assert all(r.instruction for r in kinds.values()) and kinds["category"].max_tokens == 30


def test_two_runs_close_the_answer_loop(spark):
    from kindsort.__main__ import main

    d = scratch()
    p = write(os.path.join(d, "inv.csv"), HEADER + '1,spare bracket,Acme,,1,a\n2,glove,Acme,,2,b\n')
    assert main(["--input", p, "--output", os.path.join(d, "r1"), "--skip-descriptions"]) == 0
    reqs = spark.read.parquet(os.path.join(d, "r1", "requests")).collect()
    assert [(r.stage, r.context) for r in reqs] == [("category", "Description: spare bracket, Vendor: Acme")]
    answers = spark.createDataFrame([(reqs[0].request_id, "Category: Medical Equipment & Furniture")], "request_id string, response string")
    answers.write.parquet(os.path.join(d, "answers"))
    assert main(["--input", p, "--output", os.path.join(d, "r2"), "--skip-descriptions",
                 "--completions", os.path.join(d, "answers")]) == 0
    out = {r.ITEM_NO: r[CATEGORY_COL] for r in spark.read.parquet(os.path.join(d, "r2", "table")).collect()}
    assert out == {"1": "Medical Equipment & Furniture", "2": "Medical & Surgical Supplies"}
    # the facility request now carries the answered category
    r2 = spark.read.parquet(os.path.join(d, "r2", "requests")).collect()
    assert [(r.stage, r.context) for r in r2] == [("facility", "Description: spare bracket, Category: Medical Equipment & Furniture, Vendor: Acme")]


def test_stream_equals_batch(spark):
    from kindsort.streaming.folder import file_counts, run_folder

    d = scratch()
    land = os.path.join(d, "landing")
    os.makedirs(land)
    write(os.path.join(land, "a.csv"), HEADER + BODY)
    write(os.path.join(land, "b.csv"), HEADER + '9,syringe pump,Acme,,3,q\n10,autoclave,,Misc,4,r\n')
    opts = Options(skip_descriptions=True)
    run_folder(spark, land, os.path.join(d, "out"), os.path.join(d, "ckpt"), opts)
    got = file_counts(spark, os.path.join(d, "out"))
    assert {r.file for r in got.collect()} == {"a.csv", "b.csv"}
    stream = got.groupBy(CATEGORY_COL, FACILITY_COL).agg(F.sum("rows").alias("n"))
    batch = build(S.read_inventory_csv(spark, land), opts).groupBy(CATEGORY_COL, FACILITY_COL).agg(F.count(F.lit(1)).alias("n"))
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_stream_survives_odd_files(spark):
    from kindsort.streaming.folder import file_counts, file_table, quarantine, run_folder

    d = scratch()
    land, out, ckpt = (os.path.join(d, x) for x in ("landing", "out", "ckpt"))
    os.makedirs(land)
    write(os.path.join(land, "good one+x.csv"), HEADER + BODY)
    write(os.path.join(land, "head.csv"), HEADER)
    write(os.path.join(land, "empty.csv"), "\n\n")
    write(os.path.join(land, "lacking.csv"), "ITEM_NO,DESCRIPTION\n1,glove\n")
    write(os.path.join(land, "kept.csv"), f"ITEM_NO,DESCRIPTION,VENDOR_NAME,{CATEGORY_COL},_note\n1,glove,A,Mine,n\n2,x,y,z,q,surplus\n")
    for _ in range(2):  # a restart with nothing new changes nothing
        run_folder(spark, land, out, ckpt)
        assert {r.file: r.reason for r in quarantine(spark, out).collect()} == {"empty.csv": "no header", "lacking.csv": "Missing required columns: VENDOR_NAME"}
        counts = {(r.file, r[CATEGORY_COL]): r.rows for r in file_counts(spark, out).collect()}
        assert counts["kept.csv", "Mine"] == 1 and sum(n for (f, _), n in counts.items() if f == "good one+x.csv") == 4
    kept = file_table(spark, out, "kept.csv")
    assert kept.columns == ["ITEM_NO", "DESCRIPTION", "VENDOR_NAME", CATEGORY_COL, "_note"] and kept.first()._note == "n"
    assert file_table(spark, out, "good one+x.csv").count() == 4
    assert [r.raw for r in spark.read.parquet(os.path.join(out, "rejects")).collect()] == ["2,x,y,z,q,surplus"]
    write(os.path.join(land, "late.csv"), HEADER + "5,mask,A,,1,x\n")
    run_folder(spark, land, out, ckpt)
    assert {r.file for r in file_counts(spark, out).collect()} == {"good one+x.csv", "kept.csv", "late.csv"}


def test_a_batch_is_replaced_when_it_is_replayed(spark):
    from kindsort.plans.batch import FORM_DEFAULTS
    from kindsort.streaming.folder import _process, file_counts

    d = scratch()
    p = write(os.path.join(d, "a.csv"), HEADER + BODY)
    step = _process(FORM_DEFAULTS, None, os.path.join(d, "out"))
    for _ in range(2):
        step(spark.createDataFrame([(f"file:{p}",)], "path string"), 7)
    step(spark.createDataFrame([], "path string"), 8)
    assert sum(r.rows for r in file_counts(spark, os.path.join(d, "out")).collect()) == 4


def test_store_is_read_and_appended_by_run(spark):
    d = scratch()
    store = os.path.join(d, "store")
    p = write(os.path.join(d, "inv.csv"), HEADER + "1,spare bracket,Acme,,1,a\n")
    opts = Options(skip_facility=True, skip_descriptions=True)
    run(spark, p, os.path.join(d, "r1"), opts, store=store)
    rid = spark.read.parquet(os.path.join(d, "r1", "requests")).first().request_id
    given = spark.createDataFrame([(rid, "PPE & Infection Control"), (rid, "PPE & Infection Control")], "request_id string, response string")
    run(spark, p, os.path.join(d, "r2"), opts, completions=given, store=store)
    run(spark, p, os.path.join(d, "r3"), opts, store=store)
    for r in ("r2", "r3"):
        assert [x[CATEGORY_COL] for x in spark.read.parquet(os.path.join(d, r, "table")).collect()] == ["PPE & Infection Control"]
        assert spark.read.parquet(os.path.join(d, r, "requests")).count() == 0


def test_durable_answers_and_progress(spark):
    from conftest import inventory
    from kindsort.operators import enrich as L
    from kindsort.sinks import append_completions, read_completions

    df = inventory(spark, [("spare bracket", None, None), ("foam cushion", None, None), ("glove", None, None)])
    traced = categorize(df, trace=True)
    reqs = L.requests(traced, "category")
    d = scratch()
    store = os.path.join(d, "answers")
    first = reqs.filter(F.col("context").contains("spare")).select("request_id", F.lit("PPE & Infection Control").alias("response"))
    append_completions(first, store, "category", batch_id=1)
    done = read_completions(spark, store)
    assert [r.context for r in L.pending(reqs, done).collect()] == ["Description: foam cushion"]
    out, obs = R.observe_progress(facility(traced, trace=True))
    out.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 3, "category_residual": 2, "facility_residual": 2}
    got = {r.DESCRIPTION: r[CATEGORY_COL] for r in categorize(df, completions=done).collect()}
    assert got["spare bracket"] == "PPE & Infection Control" and got["foam cushion"] == "Needs Review"


def test_stored_answers_appended_twice_keep_rows_whole(spark):
    from conftest import inventory
    from kindsort.operators import enrich as L
    from kindsort.sinks import append_completions, read_completions

    df = inventory(spark, [("spare bracket", None, None), ("spare bracket", None, None), ("foam cushion", None, None)])
    reqs = L.requests(categorize(df, trace=True), "category")
    store = os.path.join(scratch(), "answers")
    spare = reqs.filter(F.col("context").contains("spare")).dropDuplicates(["request_id"])
    append_completions(spare.select("request_id", F.lit("Diagnostics & Lab Use").alias("response")), store, "category", batch_id=1)
    append_completions(spare.select("request_id", F.lit("PPE & Infection Control").alias("response")), store, "category", batch_id=2)
    out = categorize(df, completions=read_completions(spark, store)).collect()
    assert len(out) == 3
    assert sorted(r[CATEGORY_COL] for r in out) == ["Needs Review", "PPE & Infection Control", "PPE & Infection Control"]

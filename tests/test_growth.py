"""Large inputs: what is written on the way, what is read again, and how large files are read."""

import glob
import itertools
import os
import re
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter

from conftest import inventory
from kindsort.functions.vocab import CATEGORY_COL
from kindsort.operators import classify as C
from kindsort.operators import enrich as L
from kindsort.plans import batch as B
from kindsort.plans import streams as P
from kindsort.session import ensure_checkpoint_dir
from kindsort.sources import inventory as S
from kindsort.sources import pieces
from kindsort.streaming import folder as W

HEAD = "ITEM_NO,DESCRIPTION,VENDOR_NAME\n"


def scratch():
    return tempfile.mkdtemp(prefix="kindsort-test-", dir="/tmp")


def file(d, name, text):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w", newline="") as f:
        f.write(text)


def kept(spark, name):
    return set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:").rstrip("/") + f"/kindsort-work/{name}-*"))


@pytest.fixture
def small_cuts(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_between_stages_are_stored_without_request_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", -1)
    df = inventory(spark, [("glove", "A", None), ("thing", "A", None), ("thing", "A", None), (None, "B", "x")])
    comp = L.requests(C.categorize(df, trace=True), "category").selectExpr("request_id", "'Cleaning & Facility Maintenance' as response").distinct()
    before = kept(spark, "rows")
    out = B.build(df, B.CLI_DEFAULTS, comp, None)
    new = kept(spark, "rows") - before
    assert len(new) == 2  # for the category and the facility
    for path in new:
        names = spark.read.parquet(path).columns
        assert "_cat_rid" in names and not [c for c in names if c.endswith("_ctx")]
    got = sorted((r.DESCRIPTION or "", r[CATEGORY_COL]) for r in out.collect())
    assert [g for g in got if g[0] == "thing"] == [("thing", "Cleaning & Facility Maintenance")] * 2 and len(got) == 4


def test_numbered_rows_are_stored_compressed(spark):
    before = kept(spark, "indexed")
    rows = [(r.id, r._row) for r in L.with_row_index(spark.range(100).selectExpr("99 - id as id", "repeat('x', 100) as text"), ["id"]).collect()]
    assert sorted(rows) == [(i, i) for i in range(100)]
    (new,) = kept(spark, "indexed") - before
    assert glob.glob(f"{new}/*.zstd.parquet")


def test_large_files_of_single_lines_are_not_cut_by_hand(spark, small_cuts, monkeypatch):
    d = scratch()
    file(d, "a.csv", HEAD + "".join(f'{i},"a ""b"", c",v{i}\n' for i in range(100)) + "x,1,2,3\n")
    (found,) = S.looked_at(spark, S.layouts(spark, d))
    assert found.long_records is False
    monkeypatch.setattr(pieces, "records", None)
    df = S.read_inventory_csv(spark, d)
    assert df.rdd.getNumPartitions() > 10
    assert {(r.ITEM_NO, r.DESCRIPTION, r.VENDOR_NAME) for r in df.collect()} == {(str(i), 'a "b", c', f"v{i}") for i in range(100)}
    assert [r.raw for r in S.read_rejects(spark, d).collect()] == ["x,1,2,3"]


@pytest.mark.parametrize("odd", ['7,"a\nb",c\n', "7,a\rb,c\n", "   \n", '7,a,"x""\ny"\n'])
def test_files_that_a_line_reader_takes_otherwise(spark, small_cuts, odd):
    d = scratch()
    file(d, "plain.csv", HEAD + "1,a,b\n" * 300)
    file(d, "odd é.csv", HEAD + "1,a,b\n" * 300 + odd)
    kinds = {g.long_records: [os.path.basename(f) for f in g.files] for g in S.looked_at(spark, S.layouts(spark, d))}
    assert kinds[False] == ["plain.csv"] and len(kinds[True]) == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100m")
    want = sorted(map(str, S.read_inventory_csv(spark, d).select("ITEM_NO", "DESCRIPTION", "VENDOR_NAME").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    assert sorted(map(str, S.read_inventory_csv(spark, d).select("ITEM_NO", "DESCRIPTION", "VENDOR_NAME").collect())) == want


def test_closed_lines_by_expression_and_by_scan(spark):
    lines = ["".join(x) for n in range(7) for x in itertools.product('a,"', repeat=n)] + ['"' + 'a""' * 20_000 + '"', '"' + '""' * 20_000]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.withColumn("closed", df.line.rlike(pieces.CLOSED))
    assert [r.line for r in got.collect() if r.closed == pieces.ends_open(r.line, False)] == []


@pytest.mark.parametrize("surplus", [False, True])
def test_files_are_read_again_only_for_rejects(spark, monkeypatch, surplus):
    d, asked = scratch(), []
    file(f"{d}/in", "a.csv", HEAD + "1,glove,A\n" + ("2,glove,A,more\n" if surplus else ""))
    real = S.read_rejects

    def noted(spark, path, multi_line=True, found=None):
        asked.append(len(found))
        return real(spark, path, multi_line, found)

    monkeypatch.setattr(W, "read_rejects", noted)
    monkeypatch.setattr(B, "read_rejects", noted)
    W.run_folder(spark, f"{d}/in", f"{d}/out", f"{d}/checkpoint")
    B.run(spark, f"{d}/in", f"{d}/batch", B.FORM_DEFAULTS)
    assert asked == [int(surplus)] * 2
    for at in (f"{d}/out/rejects", f"{d}/batch/rejects"):
        assert spark.read.schema(S.REJECT_SCHEMA).parquet(at).count() == int(surplus)


def test_rows_go_to_python_a_few_at_a_time(spark):
    from kindsort.llm.common import small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with small_batches(spark):
        assert max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def wide_among(d, n):
    for i in range(n):
        file(f"{d}/in", f"{i:02}.csv", HEAD + f"{i},glove,A\n")
    file(f"{d}/in", "a b+c.csv", HEAD + "," * 30_000 + "\n")


@pytest.mark.parametrize("told", [True, False])
def test_an_unreadable_file_is_found_in_few_steps(spark, monkeypatch, told):
    d, asked = scratch(), []
    wide_among(d, 12)
    real = W.read_inventory_csv

    def noted(spark, files, **kw):
        asked.append(len(files))
        return real(spark, files, **kw)

    monkeypatch.setattr(W, "read_inventory_csv", noted)
    if not told:  # by halves alone
        monkeypatch.setattr(W, "_named", lambda e: set())
    W.run_folder(spark, f"{d}/in", f"{d}/out", f"{d}/checkpoint", B.Options(skip_facility=True, skip_descriptions=True, multi_line=False))
    assert len(asked) <= (4 if told else 9)
    assert {r.file: r.rows for r in W.file_counts(spark, f"{d}/out").collect()} == {f"{i:02}.csv": 1 for i in range(12)}
    assert [r.file for r in W.quarantine(spark, f"{d}/out").collect()] == ["a b+c.csv"]


def test_a_fault_costs_its_portion_alone(spark, small_cuts, monkeypatch):
    d, asked = scratch(), []
    wide_among(d, 36)
    real = W.read_inventory_csv

    def noted(spark, files, **kw):
        asked.append(len(files))
        return real(spark, files, **kw)

    monkeypatch.setattr(W, "read_inventory_csv", noted)
    monkeypatch.setattr(W, "_portions", lambda spark, pieces, lengths: [pieces[i : i + 12] for i in range(0, len(pieces), 12)])
    W.run_folder(spark, f"{d}/in", f"{d}/out", f"{d}/checkpoint", B.Options(skip_facility=True, skip_descriptions=True, multi_line=False))
    assert sum(asked) <= 37 + 2 * 12 and W.file_counts(spark, f"{d}/out").count() == 36


def test_portions_hold_all_files_in_like_sizes(spark):
    full = spark.sparkContext.defaultParallelism * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    pieces = [(S.Layout(("a",), ()), f"file:/in/{i}") for i in range(40)]
    for size, n in ((0, 1), (full // 100, 1), (full // 4, 10)):
        got = W._portions(spark, pieces, {f: size for _, f in pieces})
        assert [p for g in got for p in g] == pieces and len(got) == n
        assert max(map(len, got)) - min(map(len, got)) <= 1


def test_rows_are_written_by_code_that_the_jvm_compiles(spark):
    before, seen = spark.conf.get("spark.sql.codegen.hugeMethodLimit"), []

    class Rows:
        sparkSession = spark

        @property
        def write(self):
            seen.append(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))
            return spark.range(1).selectExpr("id", "1 as k").write

    W._write(Rows(), f"{scratch()}/rows", ["k"])
    assert seen == ["8000"] and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


def test_ids_are_worked_out_once_a_file(spark):
    d = scratch()
    for name in ("plain.csv", "a b+c%20é.csv"):
        file(f"{d}/in", name, HEAD + "1,glove,A\n2,mask,B\n")
    files = [r.path for r in spark.read.format("binaryFile").load(f"{d}/in").select("path").collect()]
    df = S.read_inventory_csv(spark, files).withColumnRenamed("VENDOR_NAME", "__file_path")
    source = S.added(df, "file")
    got = W._with_ids(df, source, files[:1])  # the other file's are worked out row by row
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 4 and {r[W.FILE_KEY] for r in got.collect()} == {W._id(f) for f in files}
    assert got.where(W._id_column(got[source]) != got[W.FILE_KEY]).count() == 0
    assert got.columns == [*df.columns, W.FILE_KEY]


def test_rules_of_a_row_fit_a_method_that_the_jvm_compiles(spark):
    df = inventory(spark, [("glove", "A", "b")]).selectExpr("*", *(f"'x' as c{i}" for i in range(5)))
    df = df.observe("rows", L.F.count(L.F.lit(1)).alias("n"))  # as in the stream: the rules are a stage of their own
    res = B.build(df, B.Options(skip_descriptions=True), trace="_t")
    said = spark._jvm.PythonSQLUtils.explainString(res._jdf.queryExecution(), "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", said)]
    assert len(sizes) > 1 and max(sizes) <= 8000


def test_asked_requests_are_not_sorted(spark, monkeypatch):
    d, plans, real = scratch(), {}, W._write
    file(f"{d}/in", "a.csv", HEAD + "1,thing,A\n2,thing,A\n3,other,A\n")
    file(f"{d}/in", "b.csv", HEAD + "1,thing,A\n")

    def noted(df, path, keys):
        plans[os.path.basename(path)] = df._jdf.queryExecution().executedPlan().toString()
        real(df, path, keys)

    monkeypatch.setattr(W, "_write", noted)
    W.run_folder(spark, f"{d}/in", f"{d}/out", f"{d}/checkpoint")
    assert "HashAggregate" in plans["asked"] and "SortAggregate" not in plans["asked"]
    asked = spark.read.parquet(f"{d}/out/asked").groupBy("context").count().collect()
    assert sorted(r["count"] for r in asked) == [1, 2] and W.issued_requests(spark, f"{d}/out").count() == 2


@pytest.mark.parametrize("query", ["folder_versions", "stream_requests", "stream_progress"])
def test_an_inventory_lands_in_one_pass(spark, monkeypatch, query):
    rows = [(f"1-{i}", "thing" if i else "glove", "A") for i in (0, 1, 2, 1)] + [(None, "mask", "B")]  # one slice has no rows, one row no slice
    monkeypatch.setattr(P, "lineitem_inventory", lambda spark, d: inventory(spark, rows, ("ITEM_NO", "DESCRIPTION", "VENDOR_NAME")).withColumn("SLICE", P._slice()))
    written, real = [], DataFrameWriter.csv

    def noted(self, path, *args, **kw):
        written.append(path)
        return real(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "csv", noted)
    got = getattr(P, query)(spark, None).collect()
    assert [p for p in written if "-none/" not in p] == written[:1]
    if query == "stream_requests":
        assert len(got) == 1
    elif query == "stream_progress":
        assert {(r.stage, r.total, r.completed) for r in got} == {("category", 4, 1), ("facility", 4, 1)}
    else:
        assert sum(r.n_rows for r in got) == 4 and len({r[CATEGORY_COL] for r in got}) == 2

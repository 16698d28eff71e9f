"""Quality: held-out accuracy, odd rows."""

import math
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from kindsort.llm import quality
from kindsort.llm.queries import op1_quality


def test_query(spark):
    got = op1_quality(spark, SF_ORACLE).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF_ORACLE}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    kept = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in kept) / len(kept) > 0.9
    assert sum(p for p, y in kept if y) / sum(y for _, y in kept) > 0.97


def test_labels_of_the_held_out_fold_are_not_read(spark, make, folder):
    rows = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").limit(400)
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    a = quality.train(rows, labels)
    b = quality.train(rows, labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert a.good == b.good and a.bad == b.bad and (a.weights == b.weights).all()


def plain_score(text, model):
    """The score by hand: sizes of 2 KB pieces under either dictionary and of the whole text, through the calibration."""
    data = (text or "").encode()
    size = {}
    for name, known in (("good", model.good), ("bad", model.bad)):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known), write_content_size=False, write_dict_id=False)
        size[name] = sum(len(c.compress(data[i : i + 2048])) for i in range(0, len(data), 2048))
    own = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data))
    d = (size["good"] - size["bad"]) / max(1, *size.values())
    n = max(1, len(data))
    x, y = math.log((own + 1) / n), math.log(max(1, min(size.values())) / n)
    f = np.clip((np.array([d, x, y, d * d, x * x, y * y, d * x, d * y, x * y]) - model.mean) / model.scale, -4, 4)
    return 1 / (1 + math.exp(-np.clip(f @ model.weights[:-1] + model.weights[-1], -30, 30)))


def test_scores_equal_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op1_quality(spark, SF_ORACLE).collect():
        assert abs(r["score"] - plain_score(texts[r["doc_id"]], model)) < 1e-9


def test_samples_are_spread_over_the_whole_text():
    data = bytes(i // 1024 % 256 for i in range(100 * 1024))
    assert [p[0] for p in quality.spread(data)] == [0, 14, 28, 42, 56, 70, 84, 99]
    assert b"".join(quality.spread(data[:5000])) == data[:5000] and quality.spread(b"") == [] and len(quality.spread(data, 1)) == 1


def test_odd_rows(spark, make):
    good = [(f"the {i} quick brown fox jumps over lazy dog number {i * 7}. ", 1) for i in range(60)]
    bad = [(f"$$$ ### BUY {i}!! && %%% CLICK!! {i * 3} ", 0) for i in range(60)]
    model = quality.fit(good + bad)
    rows = [(1, None), (2, ""), (None, good[3][0]), (4, bad[5][0]), (4, bad[5][0]), (5, "é" * 300_000), (6, "퟿\U0010ffff")]
    out = make(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("s", quality.quality(spark, F.col("text"), model)).collect()
    assert len(out) == 7 and all(0 <= r["s"] <= 1 for r in out)
    assert out[0]["s"] == out[1]["s"] and out[2]["s"] > 0.5 > out[3]["s"] == out[4]["s"]
    assert make([], "text string").withColumn("s", quality.quality(spark, F.col("text"), model)).count() == 0


def test_constant_without_both_labels(spark, make, folder):
    sf = folder(documents=make([(1, "a"), (2, None)], "doc_id long, text string"), labels=make([], "doc_id long, quality int, toxic int"))
    assert [r["score"] for r in op1_quality(spark, sf).collect()] == [0.5, 0.5]
    assert quality.fit([("a", 1)] * 9).constant == 1.0


def test_too_little_to_learn_from_is_no_crash():
    for rows in ([("a", 1), ("b", 1), ("c", 0), ("d", 0)], [("", 1)] * 2 + [("", 0)] * 2):
        model = quality.fit(rows)
        assert 0 <= quality.score_of("x" * 5000, model, quality.Sizes(model.good, model.bad)) <= 1

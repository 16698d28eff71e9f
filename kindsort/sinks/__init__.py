"""Sinks: widened CSV/parquet output (K1), durable answers (K2), report text (K3), run record (K4)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import one_answer
from ..session import released
from ..sources.inventory import data_columns

CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": '""',
}

RUN_RECORD_SCHEMA = "run_id string, stage string, seconds double, rows long"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", order_by: list[str] | None = None) -> None:
    """K1: the input's columns and the outputs, header, nulls as empty cells; one file per task.

    Columns that the source added (marked in their metadata) stay out.  With
    ``order_by`` the rows are range-sorted, so the part files in name order hold
    them in that order."""
    out = df.orderBy(*order_by) if order_by else df
    with released(df.sparkSession):
        out.select(*(f"`{c}`" for c in data_columns(df))).write.mode(mode).options(**CSV_WRITE_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with released(df.sparkSession):
        w.parquet(path)


def append_completions(completions: DataFrame, path: str, stage: str, batch_id: int | None = None) -> None:
    """K2: answers survive a crash; a rerun anti-joins pending requests against them."""
    b = batch_id if batch_id is not None else int(time.time() * 1000)
    (
        completions.select("request_id", "response")
        .withColumn("stage", F.lit(stage))
        .withColumn("batch_id", F.lit(b).cast("long"))
        .write.mode("append")
        .partitionBy("stage")
        .parquet(path)
    )


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers, one per request: the latest batch wins; of one batch, the largest text."""
    return one_answer(spark.read.schema("request_id string, response string, batch_id long, stage string").parquet(path))


def write_report(report: DataFrame, path: str) -> None:
    """K3 text in order: a range sort, so the part files in name order are the report.

    A few dozen lines end up in one file; many preserved labels spread over tasks."""
    place = [F.col("place")] if "place" in report.columns else []
    ordered = report.orderBy(F.col("section"), *place, F.desc("sort_count"), F.col("sort_label"))
    ordered.select("line").write.mode("overwrite").text(path)


class RunRecord:
    """K4: one ``(run_id, stage, seconds, rows)`` row per materialised stage."""

    def __init__(self, spark: SparkSession, run_id: str | None = None):
        self.spark = spark
        self.run_id = run_id or uuid.uuid4().hex
        self.rows: list[tuple[str, str, float, int]] = []
        self.progress: dict[str, dict] = {}  # live counts of a stage, once it ran

    def timed(self, stage: str, action):
        """Run ``action()`` (returns the stage's row count) and record it."""
        t0 = time.perf_counter()
        n = action()
        self.rows.append((self.run_id, stage, time.perf_counter() - t0, int(n) if n is not None else None))
        return n

    def to_df(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, RUN_RECORD_SCHEMA)

    def counts(self) -> DataFrame:
        """``(stage, rows)`` without the times."""
        return self.to_df().select("stage", "rows")

    def append_to(self, path: str) -> None:
        self.to_df().write.mode("append").parquet(path)

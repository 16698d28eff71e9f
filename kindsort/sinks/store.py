"""K2: answers of all runs in a table bucketed by request id.

``base`` holds one answer a request, bucketed and sorted by its id, so a join with it
moves only the rows that ask.  New answers are appended in batches beside it; a look-up
reads the base and the few batches since, and :meth:`AnswerStore.merge` makes a new base
of both.  A base is complete or not there: its folder counts once Spark has marked it
written, and the one before stays readable.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import one_answer

ANSWER = "request_id string, response string"


class AnswerStore:
    """Answers under ``path``, in ``buckets`` buckets (fixed by the first base)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, merge_after: int = 8):
        self.spark, self.path, self.merge_after = spark, path.rstrip("/"), merge_after
        self.buckets = buckets
        if last := self._last():
            self.buckets = last[1]

    def _folders(self, name: str, pattern: str) -> list[re.Match]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        return [m for s in fs.listStatus(p) if (m := re.fullmatch(pattern, s.getPath().getName())) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]

    def _last(self) -> tuple[int, int] | None:
        """(last batch, buckets) of the newest complete base."""
        found = [(int(m[1]), int(m[2])) for m in self._folders("base", r"upto-(-?\d+)-buckets-(\d+)")]
        return max(found, default=None)

    def _table(self, upto: int) -> tuple[str, str]:
        """Catalog name and folder of a base."""
        at = f"{self.path}/base/upto-{upto}-buckets-{self.buckets}"
        return f"kindsort_answers_{hashlib.sha256(at.encode()).hexdigest()[:16]}", at

    def base(self) -> DataFrame | None:
        """``request_id, response`` of everything merged so far, as a bucketed table."""
        last = self._last()
        if last is None:
            return None
        name, at = self._table(last[0])
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({ANSWER}) USING parquet CLUSTERED BY (request_id) SORTED BY (request_id) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        return self.spark.table(name)

    def batches(self) -> list[int]:
        """The batches appended since the base."""
        last, found = self._last(), [int(m[1]) for m in self._folders("recent", r"batch-(-?\d+)")]
        return sorted(b for b in found if last is None or b > last[0])

    def recent(self) -> DataFrame | None:
        """One answer a request of the batches since the base: the latest batch, then the largest text."""
        numbers = self.batches()
        if not numbers:
            return None
        parts = [self.spark.read.schema(ANSWER).parquet(f"{self.path}/recent/batch-{b}").withColumn("batch_id", F.lit(b).cast("long")) for b in numbers]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return one_answer(every)

    def append(self, completions: DataFrame, batch_id: int) -> None:
        """Adds a batch; the same batch again replaces itself.  Merges once ``merge_after`` batches wait."""
        last = self._last()
        if last is not None and batch_id <= last[0]:
            raise ValueError(f"batch {batch_id} is not after the merged ones (up to {last[0]})")
        completions.select("request_id", "response").write.mode("overwrite").parquet(f"{self.path}/recent/batch-{batch_id}")
        if len(self.batches()) >= self.merge_after:
            self.merge()

    def merge(self) -> None:
        """A new base of the last one and the batches since; only the batches are aggregated and moved."""
        new, old, numbers = self.recent(), self.base(), self.batches()
        if new is None:
            return
        if old is None:
            whole = new.repartition(self.buckets, "request_id")
        else:
            o = old.withColumnRenamed("response", "before")
            whole = o.join(new.hint("shuffle_merge"), "request_id", "full").select("request_id", F.coalesce("response", "before").alias("response"))
        name, at = self._table(numbers[-1])
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        whole.write.mode("overwrite").bucketBy(self.buckets, "request_id").sortBy("request_id").option("path", at).format("parquet").saveAsTable(name)

    def look_up(self, rows: DataFrame, rid: str, out: str = "response") -> DataFrame:
        """``rows`` with the stored answer to the request id in column ``rid`` (null: none); the base is not moved."""
        columns = [F.col(f"`{c}`") for c in rows.columns]
        found: list[str] = []
        for side, answers in (("recent", self.recent()), ("base", self.base())):
            if answers is not None:
                key, value = f"__{side}_key", f"__{side}_response"
                rows = rows.join(answers.select(F.col("request_id").alias(key), F.col("response").alias(value)), F.col(f"`{rid}`") == F.col(key), "left")
                found.append(value)
        answer = F.coalesce(*found) if found else F.lit(None).cast("string")
        return rows.select(*columns, answer.alias(out))

    def answers(self) -> DataFrame:
        """``request_id, response`` of every stored request."""
        new, old = self.recent(), self.base()
        if old is None:
            return new if new is not None else self.spark.createDataFrame([], ANSWER)
        if new is None:
            return old
        return old.withColumnRenamed("response", "before").join(new, "request_id", "full").select("request_id", F.coalesce("response", "before").alias("response"))

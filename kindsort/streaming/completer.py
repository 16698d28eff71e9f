"""L8 + K2: answers that are durable while they are being given.

Pending requests are queued in files of a bounded number of rows, and a checkpointed
stream (``availableNow``) answers the queue a few files a micro-batch.  Every attempt of a
batch is a written table of its own, complete or absent: when the completer fails, the
batches before keep their answers, the failed batch keeps its finished attempts, and the
next run asks only the rest.  A request without an answer is asked again within its batch,
three attempts in all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import MAX_ATTEMPTS
from ..operators.enrich import ATTEMPT_SCHEMA, REQUEST_SCHEMA, pending
from .folder import _exists

QUEUE_COLUMNS = [c.split()[0] for c in REQUEST_SCHEMA.split(", ")]
#: The answer function's frame: the request, and which batch and attempt asks it.
Answer = Callable[[pd.DataFrame], "pd.Series | pd.DataFrame"]


def enqueue(reqs: DataFrame, store: str, batch_rows: int) -> int:
    """Appends the distinct requests that were never queued to ``<store>/queue``, ``batch_rows`` a file; how many."""
    spark = reqs.sparkSession
    at = f"{store}/queue"
    known = spark.read.schema(REQUEST_SCHEMA).parquet(at).select("request_id") if _exists(spark, at) else None
    todo = pending(reqs.select(*QUEUE_COLUMNS), known).checkpoint()
    n = todo.count()
    if n:
        todo.repartition(-(-n // batch_rows)).write.mode("append").option("maxRecordsPerFile", batch_rows).parquet(at)
    return n


def _asked(answer: Answer, batch_id: int, attempt: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asked in frames:
            given = answer(asked.assign(batch_id=batch_id, attempt=attempt))
            out = given.reset_index(drop=True) if isinstance(given, pd.DataFrame) else pd.DataFrame({"response": pd.Series(given, dtype=object).reset_index(drop=True)})
            answered = out["response"].notna()
            for column, value in (("responded", answered), ("error", None), ("total_tokens", None)):
                if column not in out:
                    out[column] = value
            out["response"] = out["response"].astype(object).where(answered, None)
            yield pd.DataFrame({"request_id": asked["request_id"].reset_index(drop=True), "attempt": attempt, **{c: out[c] for c in ("responded", "response", "error", "total_tokens")}})

    return run


def complete_stream(
    reqs: DataFrame,
    store: str,
    checkpoint: str,
    answer: Answer,
    batch_rows: int = 10_000,
    files_a_batch: int = 1,
    partitions: int | None = None,
    attempts: int = MAX_ATTEMPTS,
):
    """Asks ``answer`` for every request that was never answered; the answers stay whatever happens.

    ``answer`` gets a frame of requests with ``batch_id`` and ``attempt`` and returns a
    response a row (None: failed), or a frame ``response[, responded, error,
    total_tokens]``.  At most ``batch_rows * files_a_batch`` requests are at stake at a
    time; ``partitions`` tasks ask at once.  If it raises, so does this function, after
    what was given before has been kept; a request of a task that Spark repeats may be
    asked twice, but has one answer."""
    spark = reqs.sparkSession
    enqueue(reqs, store, batch_rows)
    if not _exists(spark, f"{store}/queue"):
        return None

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        left = batch.repartition(partitions, "request_id") if partitions else batch
        for n in range(1, attempts + 1):
            at = f"{store}/log/batch_id={batch_id}/attempt={n}"
            if not _exists(s, f"{at}/_SUCCESS"):
                tried = left.mapInPandas(_asked(answer, batch_id, n), ATTEMPT_SCHEMA)
                tried.drop("attempt").write.mode("overwrite").parquet(at)
            failed = s.read.parquet(at).where("response is null").select("request_id")
            if failed.isEmpty():
                return
            left = left.join(failed, "request_id", "left_semi")

    queue = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", str(files_a_batch)).parquet(f"{store}/queue")
    q = queue.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def attempt_log(spark: SparkSession, store: str) -> DataFrame:
    """Every finished attempt (``ATTEMPT_SCHEMA`` and ``batch_id``); input of ``resolve_attempts``."""
    if not _exists(spark, f"{store}/log"):
        return spark.createDataFrame([], f"{ATTEMPT_SCHEMA}, batch_id long")
    return spark.read.schema(f"{ATTEMPT_SCHEMA}, batch_id long").parquet(f"{store}/log")


def given_answers(spark: SparkSession, store: str) -> DataFrame:
    """``request_id, response, batch_id`` of every request answered so far, also while a run goes on or after it failed."""
    return attempt_log(spark, store).where("response is not null").select("request_id", "response", "batch_id")

"""Session helpers: a tuned local session for tests/bench, the shared work folder, the package on executors."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Spark SQL settings the engine relies on; all are runtime-settable.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the matcher ships whole texts to Python in Arrow batches: bound a batch
    # by bytes as well as rows, so 20,000-word documents cannot make one huge batch
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kindsort", checkpoint_dir: str | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("KINDSORT_DRIVER_MEMORY", "16g"))
    )
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The session's setting is used as is.  A local session without one works
    under its warehouse folder; a cluster session without one is an error,
    because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_kindsort"
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared work folder for written tables and streams."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/kindsort-work/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written once to the shared work folder and read back from there.

    As a reliable checkpoint it ends the plan and survives a lost executor; unlike one it
    is compressed column by column, and a branch reads only the columns that it uses.
    What parquet cannot hold is checkpointed."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or re.search(r"\b(void|interval|variant)\b", df.schema.simpleString()):
        return df.checkpoint()
    path = work_path(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    for made in getattr(_NOTED, "lists", []):
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The lists of :func:`noted` that this thread is in.
_NOTED = threading.local()


@contextmanager
def noted():
    """The folders that :func:`stored` writes in the block, as a list."""
    lists = _NOTED.__dict__.setdefault("lists", [])
    made: list[str] = []
    lists.append(made)
    try:
        yield made
    finally:
        lists[:] = [x for x in lists if x is not made]


def let_go(spark: SparkSession, made: list[str], *readers: DataFrame) -> None:
    """Deletes the folders of ``made`` that none of ``readers`` reads: what came of them is written elsewhere."""
    read = [f for df in readers for f in df.inputFiles()]
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in made:
        if not any(f"/{folder.rsplit('/', 1)[1]}/" in f for f in read):
            path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def released(spark: SparkSession):
    """For a write: its shuffle files go when it ends, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def compiled(spark: SparkSession):
    """For rows of many expressions: no generated method that the JVM only interprets.

    HotSpot compiles methods of up to 8,000 bytes of code.  The rules of a row give more in
    whole-stage code; above the limit Spark runs operator by operator, in short methods."""
    return setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable on every executor, once a session.

    Spark's file server distributes a zip of the sources, as ``--py-files``
    would; a package that is installed on all machines does no harm.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # not itself running from a zip
        archive = Path(tempfile.mkdtemp(prefix="kindsort-")) / "kindsort.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)

"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution on; extra settings by keyword (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _hadoop_path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, with its file system.

    A folder without a scheme lies in the default file system, as Spark itself takes it. Where it is
    unset, a local session gets a temporary folder; any other is refused,
    because a machine-local folder would be invisible to other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        path, system = _hadoop_path(spark, found)
        return system.makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    made = "file://" + tempfile.mkdtemp(prefix="millrace-", dir="/tmp/checkpoints")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_SCRATCH: list[list[str]] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; removed at the end of the innermost ``scratch``, if any."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    made, system = _hadoop_path(spark, path)
    system.delete(made, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediates written inside are removed at the end: results must be written or collected by then."""
    held: list[str] = []
    _SCRATCH.append(held)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for path in held:
            remove(spark, path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, executors may be lost."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hold Arrow batches to ``rows`` rows: texts are long, and both sides of a Python stage hold a batch for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))

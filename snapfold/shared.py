"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local master that names none gets a temporary folder, any other an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


#: Spark removes the shuffle files of a query that was planned under this setting as soon as it ends, also on executors.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _cleaning = threading.Lock(), {}


@contextmanager
def leaving_no_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind, which else stay until the driver collects its garbage. Several threads may be
    inside; the session's own setting comes back with the last."""
    at = spark.sparkContext.applicationId
    with _lock:
        inside, before = _cleaning.get(at, (0, None))
        _cleaning[at] = (inside + 1, before if inside else spark.conf.get(_CLEAN))
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            inside, before = _cleaning[at]
            _cleaning[at] = (inside - 1, before)
            if inside == 1:
                spark.conf.set(_CLEAN, before)


def forget(df: DataFrame) -> None:
    """Remove the files of a table that `cut` wrote and nothing reads any more."""
    for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        jpath = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df once to the shared folder and read it back: later steps neither recompute nor depend on an executor."""
    path = scratch_path(df.sparkSession, name)
    with leaving_no_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

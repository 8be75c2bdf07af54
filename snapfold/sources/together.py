"""Tables of one job that are all bucketed by one key, mostly the owner, so that steps keyed by owner and more move no rows.

A table is dealt by owner once, when it enters; what is worked out from such tables keeps their partitioning and is written in
the same buckets. Spark must be told that joins may rest on a part of their keys (`moving_nothing`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from snapfold.shared import leaving_no_shuffles, scratch_path

#: Joins on the owner and other columns take tables dealt by owner as they are, none is sent everywhere instead, and a union of
#: bucketed tables does not count as bucketed (Spark 4.1 may read its parts without their buckets, and lets equal rows stay).
_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def moving_nothing(spark: SparkSession) -> Iterator[None]:
    """The settings that let steps keyed by owner and more use the buckets; the session's own ones come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Together:
    """Writes tables in `buckets` buckets by `key`. They are external tables of the session's catalog in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, key: str = "owner_id"):
        self.spark, self.key, self.path, self.names = spark, key, scratch_path(spark, "together"), []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def enter(self, df: DataFrame) -> DataFrame:
        """A table that may lie anywhere, dealt by the key."""
        return self.hold(df.repartition(self.buckets, self.key))

    def hold(self, df: DataFrame) -> DataFrame:
        name = f"together_{uuid.uuid4().hex}"
        self.names.append(name)
        with leaving_no_shuffles(self.spark):
            df.write.bucketBy(self.buckets, self.key).option("path", f"{self.path}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def forget(self, but: list[DataFrame] = ()) -> None:
        """Drop the tables, other than those given, with their files."""
        kept = {p.split("/")[-2] for df in but for p in df.inputFiles()}
        for name in [n for n in self.names if n not in kept]:
            self.spark.sql(f"drop table if exists {name}")
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            self.names.remove(name)


def at_once(steps: list[Callable[[], DataFrame]], most: int = 4) -> list[DataFrame]:
    """Results of steps that don't need each other; some of their jobs run side by side."""
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(lambda step: step(), steps))

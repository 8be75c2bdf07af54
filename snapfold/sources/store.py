"""Published tables by bucket of the owner: a run for few owners reads and writes their buckets alone.

Rows lie in path/table=NAME/bucket=K/run=R. A bucket that a run touches is written anew under that run; which run of each
bucket counts stands in path/current, written last and under one name, so a run is there as a whole or not at all.
A run that failed is done again over what it left; one that is published is not done again.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapfold.sources.together import at_once


class Store:
    """schemas: type of each table as DDL; each has owner_id. buckets is fixed for the life of a store."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], buckets: int = 64):
        self.spark, self.path, self.schemas, self.buckets = spark, path.rstrip("/"), schemas, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("owner_id").cast("long")), F.lit(self.buckets)).cast("int")

    @cached_property
    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _runs(self) -> list[str]:
        folder = self._at(f"{self.path}/current")
        return sorted(f.getPath().toString() for f in self._fs.listStatus(folder) if f.getPath().getName().startswith("run-")) if self._fs.exists(folder) else []

    def _name(self, run: int) -> str:
        return f"{self.path}/current/run-{run:012d}.json"

    def published(self, run: int) -> bool:
        return self._fs.exists(self._at(self._name(run)))

    def current(self) -> dict[int, int]:
        """The run that counts of each bucket: at most `buckets` entries."""
        runs = self._runs()
        return {int(k): r for k, r in json.loads(self.spark.read.text(runs[-1], wholetext=True).first()[0]).items()} if runs else {}

    def buckets_of(self, owners: DataFrame) -> list[int]:
        return sorted(r[0] for r in owners.select(self.bucket().alias("b")).distinct().collect())

    def _paths(self, name: str, at: list[tuple[int, int]]) -> list[str]:
        return [p for p in (f"{self.path}/table={name}/bucket={k}/run={r}" for k, r in at) if self._fs.exists(self._at(p))]

    def _where(self, buckets: list[int] | None) -> list[tuple[int, int]]:
        return [(k, r) for k, r in self.current().items() if buckets is None or k in buckets]

    def filled(self, owners: DataFrame) -> set[str]:
        """Tables that have files in the buckets of these owners."""
        at = self._where(self.buckets_of(owners))
        return {n for n in self.schemas if self._paths(n, at)}

    def _read(self, buckets: list[int] | None) -> dict[str, DataFrame]:
        at, out = self._where(buckets), {}
        for name, ddl in self.schemas.items():
            schema, paths = T.StructType.fromDDL(ddl), self._paths(name, at)
            found = self.spark.read.schema(schema).option("basePath", f"{self.path}/table={name}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
            out[name] = found.select(*schema.names)
        return out

    def read(self, owners: DataFrame | None = None) -> dict[str, DataFrame]:
        """All tables, whole or of some owners; then only files of those owners' buckets are read."""
        if owners is None:
            return self._read(None)
        own = owners.select("owner_id").distinct()
        return {n: df.join(own, "owner_id", "left_semi") for n, df in self._read(self.buckets_of(own)).items()}

    def publish(self, tables: dict[str, DataFrame], owners: DataFrame, run: int) -> None:
        """Put the rows of `tables` in place of all rows of `owners`; a table that is not given loses theirs."""
        if self.published(run):
            return
        own = owners.select("owner_id").distinct()
        touched = self.buckets_of(own)
        at = self._where(touched)

        def write(name: str, old: DataFrame) -> None:
            rows = old.join(own, "owner_id", "left_anti")
            if name in tables:
                fields = T.StructType.fromDDL(self.schemas[name])
                rows = rows.unionByName(tables[name].select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)))
            for k in touched:
                self._fs.delete(self._at(f"{self.path}/table={name}/bucket={k}/run={run}"), True)
            placed = rows.withColumns({"bucket": self.bucket(), "run": F.lit(run)}).repartition("bucket", "owner_id").sortWithinPartitions("bucket", "owner_id")
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run").parquet(f"{self.path}/table={name}")

        at_once([lambda n=n, df=df: write(n, df) for n, df in self._read(touched).items() if n in tables or self._paths(n, at)])
        self._point(self.current() | dict.fromkeys(touched, run), run)

    def _point(self, now: dict[int, int], run: int) -> None:
        aside = self._at(f"{self.path}/current/.aside-{run}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        self._fs.rename(aside, self._at(self._name(run)))

    def forget(self, keep: int = 2) -> None:
        """Delete files that none of the last `keep` runs counts on. No reader may still hold an older one."""
        runs = self._runs()[-keep:]
        needed = {(int(k), r) for p in runs for k, r in json.loads(self.spark.read.text(p, wholetext=True).first()[0]).items()}
        for path in self._runs()[:-keep]:
            self._fs.delete(self._at(path), False)
        for name in self.schemas:
            top = self._at(f"{self.path}/table={name}")
            for bucket in self._fs.listStatus(top) if self._fs.exists(top) else []:
                k = bucket.getPath().getName().partition("=")[2]
                for f in self._fs.listStatus(bucket.getPath()) if k.isdigit() else []:
                    r = f.getPath().getName().partition("=")[2]
                    if r.isdigit() and (int(k), int(r)) not in needed:
                        self._fs.delete(f.getPath(), True)

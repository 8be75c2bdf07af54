"""Order of snapshots, choice of the base, and gates before a merge. Snapshot rows: owner_id, snapshot_id, input_ord,
last_modified, creation_date, schema_version, and is_stable where an earlier merge takes part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KNOWN_VERSIONS = (14, 15, 16)
NOT_MEDIA = ("userData.db", "manifest.json", "userData.db-wal", "userData.db-shm", "userData.db-journal")


def sort_stamp() -> Column:
    """Stamps are compared as strings; the creation date stands in for an empty modification date."""
    return F.coalesce(F.nullif(F.col("last_modified"), F.lit("")), F.col("creation_date"), F.lit(""))


def with_seq(snapshots: DataFrame) -> DataFrame:
    """seq: 0 for the newest snapshot of an owner, which is the base; ties stay in input order."""
    order = W.partitionBy("owner_id").orderBy(sort_stamp().desc(), "input_ord")
    return snapshots.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))


def with_seq_accumulating(snapshots: DataFrame, fresh: bool = False) -> DataFrame:
    """As with_seq, but an earlier merged output is the base whatever its date; fresh leaves it out."""
    rows = snapshots.filter(~F.col("is_stable")) if fresh else snapshots
    order = W.partitionBy("owner_id").orderBy(F.col("is_stable").desc(), sort_stamp().desc(), "input_ord")
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))


def version_gate(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots of owners whose versions all equal the base's, refused snapshots with base_version)."""
    base = ordered.filter("seq = 0").select("owner_id", F.col("schema_version").alias("base_version"))
    joined = ordered.join(base, "owner_id")
    differs = ~F.col("schema_version").eqNullSafe(F.col("base_version"))
    refused = joined.filter(differs)
    return ordered.join(refused.select("owner_id").distinct(), "owner_id", "left_anti"), refused


def version_warnings(snapshots: DataFrame, known: tuple[int, ...] = KNOWN_VERSIONS) -> DataFrame:
    return snapshots.filter(~F.coalesce(F.col("schema_version").isin(*known), F.lit(False)))


def enough_inputs(snapshots: DataFrame, least: int = 2) -> DataFrame:
    """Snapshots of owners that have at least `least` of them."""
    owners = snapshots.groupBy("owner_id").count().filter(F.col("count") >= least)
    return snapshots.join(owners, "owner_id", "left_semi")


def media_members(members: DataFrame) -> DataFrame:
    return members.filter(~F.col("member").isin(*NOT_MEDIA))


def drop_readded(files: DataFrame) -> DataFrame:
    """The first of the files of an owner with equal name and size."""
    order = W.partitionBy("owner_id", "name", "size").orderBy("input_ord")
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")

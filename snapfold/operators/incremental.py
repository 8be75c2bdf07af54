"""What changed since the last merge, when to merge, and the registry of owners and their devices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fingerprints(listing: DataFrame, *keys: str) -> DataFrame:
    """keys, fingerprint of the set of (name, size, mtime) of each group of files.

    The digest is a sum over distinct files: of the halves of two independent 64-bit hashes, and of one each. Sums of parts of a
    set can be added, so each partition sends a row for a group, however many files it has.
    """
    by = keys or ("owner_id",)
    files = listing.select(*by, "name", "size", "mtime").distinct()
    one, two = F.xxhash64("name", "size", "mtime"), F.xxhash64(F.lit("second"), "mtime", "size", "name")
    halves = [h for x in (one, two) for h in (x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32))]
    sums = files.groupBy(*by).agg(F.count("*").alias("_n"), *(F.sum(h).alias(f"_{i}") for i, h in enumerate(halves)))
    return sums.select(*by, F.sha2(F.concat_ws(",", "_n", *(f"_{i}" for i in range(len(halves)))), 256).alias("fingerprint"))


def changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """Owners whose fingerprint differs from the stored one; no stored state counts as changed."""
    known = state.select("owner_id", F.col("fingerprint").alias("last"))
    return current.join(known, "owner_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("last"))).drop("last")


def settle(polls: DataFrame, once: bool = False) -> DataFrame:
    """When to merge: owner_id, poll and merge for each row (owner_id, poll, fingerprint, merge_ok).

    A changed fingerprint must show on two polls; the candidate survives polls that equal the merged state, and a failed
    merge (merge_ok false) clears it without being remembered. Owners are hashed to partitions and polls sorted there,
    then read once, with two fingerprints of state: no owner's polls are held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = merged = candidate = None
        fresh = True
        for batch in batches:
            out = []
            for owner, fingerprint, ok in zip(*(batch.column(c).to_pylist() for c in ("owner_id", "fingerprint", "ok"))):
                if fresh or owner != last:
                    last, merged, candidate, fresh = owner, None, None, False
                go = fingerprint != merged and (once or fingerprint == candidate)
                if go:
                    merged, candidate = (fingerprint if ok else merged), None
                elif fingerprint != merged:
                    candidate = fingerprint
                out.append(go)
            yield pa.RecordBatch.from_arrays([batch.column("owner_id"), batch.column("poll"), pa.array(out, pa.bool_())], ["owner_id", "poll", "merge"])

    rows = polls.select(F.col("owner_id").cast("long").alias("owner_id"), F.col("poll").cast("long").alias("poll"), "fingerprint", F.coalesce("merge_ok", F.lit(True)).alias("ok"))
    return rows.repartition("owner_id").sortWithinPartitions("owner_id", "poll").mapInArrow(run, "owner_id long, poll long, merge boolean")


def content_changed(inputs: DataFrame, last: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """owner_id, run: false only where the digests of all inputs equal the last run's and its output is still there.

    inputs and last: owner_id, name, digest; outputs: owner_id.
    """
    every = lambda df, name: df.groupBy("owner_id").agg(F.array_sort(F.collect_set(F.struct("name", "digest"))).alias(name))
    there = outputs.select("owner_id").distinct().withColumn("_there", F.lit(True))
    both = every(inputs, "now").join(every(last, "was"), "owner_id", "left").join(there, "owner_id", "left")
    same = F.col("now").eqNullSafe(F.col("was")) & F.coalesce("_there", F.lit(False))
    return both.select("owner_id", (~same | F.lit(force)).alias("run"))


def next_state(state: DataFrame, merged: DataFrame) -> DataFrame:
    """Stored fingerprints after a run: those of successfully merged owners (owner_id, fingerprint, ok) replace the old."""
    good = merged.filter("ok").select("owner_id", "fingerprint")
    return state.join(good, "owner_id", "left_anti").select("owner_id", "fingerprint").union(good)


def keep_runs(log: DataFrame, limit: int = 20) -> DataFrame:
    w = W.partitionBy("owner_id").orderBy(F.desc("at"))
    return log.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def devices(old: DataFrame, new: DataFrame) -> DataFrame:
    """owner_id, device, last_modified (never goes back), first_seen, seen_at over stored and new sightings."""
    both = old.select("owner_id", "device", "last_modified", "first_seen", "seen_at").unionByName(new.select("owner_id", "device", "last_modified", F.col("seen_at").alias("first_seen"), "seen_at"))
    return both.groupBy("owner_id", "device").agg(F.max("last_modified").alias("last_modified"), F.min("first_seen").alias("first_seen"), F.max("seen_at").alias("seen_at"))


def owner_list(owners: DataFrame) -> DataFrame:
    """Owners without their libraries, last used first."""
    return owners.select("owner_id", "name", "updated", F.col("library").isNotNull().alias("has_library")).orderBy(F.desc("updated"), "owner_id")


def forget_library(owners: DataFrame, who: DataFrame) -> DataFrame:
    """Clears library and summary of the owners in `who`; the rest of the record stays."""
    gone = who.select("owner_id").distinct().withColumn("_gone", F.lit(True))
    out = owners.join(gone, "owner_id", "left")
    clear = lambda c: F.when(F.col("_gone").isNull(), F.col(c)).alias(c)
    return out.select(*(clear(c) if c in ("library", "summary") else F.col(c) for c in owners.columns))


def delete_owners(owners: DataFrame, who: DataFrame) -> DataFrame:
    return owners.join(who.select("owner_id").distinct(), "owner_id", "left_anti")


def rename_owners(owners: DataFrame, names: DataFrame) -> DataFrame:
    """names: owner_id, new_name; a blank name keeps the old one."""
    out = owners.join(names, "owner_id", "left").withColumn("name", F.coalesce(F.nullif(F.trim("new_name"), F.lit("")), F.col("name")))
    return out.select(*owners.columns)


def publishable(results: DataFrame, owners: DataFrame) -> DataFrame:
    """Results (owner_id, ok, integrity_errors) that may be remembered: clean, and of an owner that still exists."""
    return results.filter("ok and integrity_errors = 0").join(owners, "owner_id", "left_semi")


def device_name(given: Column, base: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.concat(base, F.lit(" (merged)")))

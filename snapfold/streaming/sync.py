"""The sync job on streams: which owners' files have settled, and their merge, check and publication.

Listings of the owners' folders arrive as polls. A changed listing must stand still for an interval before its owner is due
(a timer of the stream's state). Each batch of due owners is merged with what is published of them, verified, checked and
published under its batch number; what was merged for which listing is part of the same publication, so it never runs ahead
of the tables. A batch that failed, wherever it did, is done again and gives the same tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from snapfold.operators import incremental, verify
from snapfold.plans import jobs
from snapfold.schema import KEY, TABLES
from snapfold.shared import cut
from snapfold.sources.store import Store

DUE = "owner_id long, fingerprint string, at timestamp"
#: Of a store of snapshots, and of a store of merged libraries.
SOURCES = {n: f"{KEY}, {spec}" for n, spec in TABLES.items()} | {"Member": "owner_id long, seq int, member string"}
LIBRARY = {n: f"owner_id long, {spec}" for n, spec in TABLES.items()} | {"Member": "owner_id long, member string", "State": "owner_id long, fingerprint string", "Run": "owner_id long, at long, new_rows long, missing long, ok boolean"}


class Settle(StatefulProcessor):
    """State of an owner: the listing seen last, with a timer since it came. A due listing is forgotten, so that the next
    poll looks at it anew: it is merged again only if that failed (see sync_batch)."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "fingerprint string, at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values(["at", "fingerprint"])
        for at, fingerprint in zip(polls["at"], polls["fingerprint"]):
            if self.seen.exists() and self.seen.get()[0] == fingerprint:
                continue
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.seen.update((fingerprint, at.to_pydatetime()))
            self.handle.registerTimer(int(at.timestamp() * 1000) + self.wait)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fingerprint, at = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"owner_id": [key[0]], "fingerprint": [fingerprint], "at": [at]})

    def close(self) -> None:
        pass


def due_stream(polls: DataFrame, interval: timedelta) -> DataFrame:
    """owner_id, fingerprint, at (since when) of listings that stood still for the interval, of a stream of polls (owner_id, at,
    fingerprint). Time is that of the polls. Needs the RocksDB state store."""
    rows = polls.select(F.col("owner_id").cast("long").alias("owner_id"), "at", "fingerprint").withWatermark("at", "0 seconds")
    return rows.groupBy("owner_id").transformWithStateInPandas(Settle(interval.total_seconds()), DUE, "Append", "EventTime")


def sync_batch(sources: Store, library: Store, due: DataFrame, run: int, now: str, **options) -> None:
    """Merge, verify and publish the due owners (owner_id, fingerprint) whose listing is not the one merged last.

    The published library of an owner is the base; without one its first snapshot is. Owners with a single input wait. A
    library with broken references or constraints is not published: its owner keeps the one there, and is due again.
    """
    if library.published(run):
        return
    state = library.read(due)["State"].withColumnRenamed("fingerprint", "last")
    last = due.groupBy("owner_id").agg(F.max_by("fingerprint", "at").alias("fingerprint")) if "at" in due.columns else due.distinct()
    changed = cut(last.join(state, "owner_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("last"))).select("owner_id", "fingerprint"), "due")
    there, found = library.read(changed), sources.read(changed)
    based = cut(there["LastModified"].select("owner_id", F.lit(1).alias("base")).distinct(), "based")
    counts = found["LastModified"].groupBy("owner_id").agg(F.countDistinct("seq").alias("n")).join(based, "owner_id", "left")
    ready = cut(changed.join(counts, "owner_id").filter(F.col("n") + F.coalesce("base", F.lit(0)) >= 2).select("owner_id", "fingerprint", F.coalesce("base", F.lit(0)).alias("base")), "ready")
    if ready.isEmpty():
        return
    shifted = {n: df.join(ready.select("owner_id", "base"), "owner_id").withColumn("seq", F.col("seq") + F.col("base")).drop("base") for n, df in found.items()}
    there_is = [n for n in TABLES if n in sources.filled(ready) | library.filled(ready)]
    base = jobs.as_base({n: there[n] for n in there_is})
    both = {n: base[n].select(*shifted[n].columns).join(ready, "owner_id", "left_semi").unionByName(shifted[n]) for n in there_is}
    members = shifted["Member"].unionByName(there["Member"].join(ready, "owner_id", "left_semi").select("owner_id", F.lit(0).alias("seq"), "member"))
    done = jobs.merge_together(both, members, now, **options)

    missing = jobs.verify_all({n: shifted[n] for n in TABLES}, done.tables).groupBy("owner_id").agg(F.count("*").alias("missing"))
    faults = verify.broken_references(done.tables).select("owner_id").union(verify.violations(done.tables).select("owner_id")).distinct()
    new = done.decisions.filter("action = 'added'").groupBy("owner_id").agg(F.count("*").alias("new_rows"))
    judged = ready.join(faults.withColumn("bad", F.lit(True)), "owner_id", "left").join(new, "owner_id", "left").join(missing, "owner_id", "left")
    judged = cut(judged.select("owner_id", "fingerprint", F.lit(run).cast("long").alias("at"), F.coalesce("new_rows", F.lit(0)).alias("new_rows"), F.coalesce("missing", F.lit(0)).alias("missing"), F.col("bad").isNull().alias("ok")), "judged")

    good = judged.filter("ok").select("owner_id")
    keep = lambda fresh, old: fresh.join(good, "owner_id", "left_semi").unionByName(old.join(judged, "owner_id", "left_semi").join(good, "owner_id", "left_anti"))
    out = {n: keep(done.tables[n], there[n]) for n in {*there_is, "LastModified"}}
    out["Member"] = keep(done.media_plan.select("owner_id", "member").distinct(), there["Member"])
    out["State"] = incremental.next_state(there["State"].join(judged, "owner_id", "left_semi"), judged)
    out["Run"] = incremental.keep_runs(there["Run"].join(judged, "owner_id", "left_semi").unionByName(judged.drop("fingerprint")))
    library.publish(out, judged, run)


def sync(polls: DataFrame, sources: Store, library: Store, checkpoint: str, interval: timedelta = timedelta(seconds=30), now: str | None = None, **options) -> StreamingQuery:
    """Start the job on a stream of polls; it takes what is there and ends. now: stamp of merged libraries, else each batch's
    latest poll, so that a batch that is done again gives the same."""

    def each(batch: DataFrame, number: int) -> None:
        due = cut(batch, "due")
        if not due.isEmpty():
            stamp = now or due.agg(F.date_format(F.max("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
            sync_batch(sources, library, due, number, stamp, **options)

    return due_stream(polls, interval).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming: when to merge, merging what arrived, and the device registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from snapfold.operators import incremental

DECISION = "owner_id long, poll long, merge boolean"


def settle_stream(polls: DataFrame) -> DataFrame:
    """The settle rule on a stream of (owner_id, poll, fingerprint, merge_ok): state is (merged, candidate) by owner.

    Polls of one batch are taken in order of their number.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        merged, candidate = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("poll")
        out = []
        for poll, fingerprint, ok in zip(rows["poll"], rows["fingerprint"], rows["merge_ok"]):
            go = merged != fingerprint and candidate == fingerprint
            if go:
                merged, candidate = (fingerprint if ok else merged), None
            elif merged != fingerprint:
                candidate = fingerprint
            out.append((key[0], poll, go))
        state.update((merged, candidate))
        yield pd.DataFrame(out, columns=["owner_id", "poll", "merge"])

    return polls.groupBy("owner_id").applyInPandasWithState(step, DECISION, "merged string, candidate string", "append", GroupStateTimeout.NoTimeout)


def device_registry(sightings: DataFrame) -> DataFrame:
    """Streaming form of the registry; write it in update mode. The latest modification never goes back."""
    return sightings.groupBy("owner_id", "device").agg(F.max("last_modified").alias("last_modified"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("seen_at"))


def merge_stream(arrivals: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run merge(changed owners, batch number) for each batch of (owner_id, ...) arrivals.

    merge must write its result under the batch number, replacing what a failed try of the same batch left, and store
    the state last: then a batch that runs twice has the effect of one.
    """

    def each(batch: DataFrame, number: int) -> None:
        merge(batch.select("owner_id").distinct(), number)

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def registry_update(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The registry after one batch, for foreachBatch sinks."""
    return incremental.devices(old, batch)

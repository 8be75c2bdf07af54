"""Files by bucket, and the sync job: killed in the middle and started again, it ends with the same tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snapfold.schema import TABLES
from snapfold.sources.store import Store
from snapfold.streaming import sync

POLLS = "owner_id long, at timestamp, fingerprint string"


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def rows_of(store):
    return {n: sorted(map(repr, df.collect())) for n, df in store.read().items()}


def files(store):
    return {f.getPath().toString(): f.getModificationTime() for n in store.schemas for b in range(store.buckets) for f in (store._fs.globStatus(store._at(f"{store.path}/table={n}/bucket={b}/run=*/*.parquet")) or [])}


def test_few_owners_read_and_write_their_buckets(spark, tmp_path):
    store = Store(spark, (tmp_path / "s").as_uri(), {"Tag": "owner_id long, Name string"}, buckets=8)
    rows = spark.range(40).select(F.col("id").alias("owner_id"), F.concat(F.lit("t"), "id").alias("Name"))
    store.publish({"Tag": rows}, rows, 1)
    assert store.read()["Tag"].count() == 40
    before, some = files(store), rows.filter("owner_id in (3, 5)")
    mine = store.buckets_of(some)
    assert 0 < len(mine) < 8
    read = store.read(some)["Tag"]
    assert sorted(r["owner_id"] for r in read.collect()) == [3, 5]
    assert {p.split("bucket=")[1].split("/")[0] for p in read.inputFiles()} == {str(k) for k in mine}
    store.publish({"Tag": some.withColumn("Name", F.lit("new"))}, some, 2)
    after = files(store)
    assert {p: t for p, t in after.items() if p in before} == before
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in set(after) - set(before)} == set(mine)
    assert store.current() == {k: 2 if k in mine else 1 for k in range(8)}
    assert sorted(r["owner_id"] for r in store.read()["Tag"].filter("Name = 'new'").collect()) == [3, 5] and store.read()["Tag"].count() == 40
    # a run is there once, and an owner may go
    store.publish({"Tag": some}, some, 2)
    assert store.read()["Tag"].filter("Name = 'new'").count() == 2
    store.publish({}, some, 3)
    assert store.read()["Tag"].count() == 38
    store.forget(1)
    assert store.read()["Tag"].count() == 38 and len(files(store)) < len(after)


def libraries(spark, path, last):
    """Snapshots of owners with tags and accuracies; `last` snapshots each."""
    store, rnd = Store(spark, path, sync.SOURCES, buckets=4), random.Random(9)
    tags = [(o, s, i, i, 1, f"t{rnd.randint(0, 9)}x{i % 3}") for o in range(6) for s in range(last if o < 5 else 1) for i in range(1, 6)]
    stamps = [(o, s, 1, f"2026-01-0{9 - s}") for o in range(6) for s in range(last if o < 5 else 1)]
    t = {"Tag": spark.createDataFrame(tags, sync.SOURCES["Tag"]), "LastModified": spark.createDataFrame(stamps, sync.SOURCES["LastModified"])}
    store.publish(t, t["LastModified"], last)
    return store


def poll(spark, folder, polls):
    start = datetime(2026, 1, 1)
    spark.createDataFrame([(o, start + timedelta(seconds=s), f) for o, s, f in polls], POLLS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, sources, library, checkpoint):
    stream = spark.readStream.schema(POLLS).parquet(folder)
    return sync.sync(stream, sources, library, checkpoint, timedelta(seconds=30), buckets=4)


def a_round(spark, top, library, last, killed=False):
    """Polls of all owners, twice; `killed`: the pointer of the publication can't be written at first."""
    sources = libraries(spark, f"{top}/sources{last}", last)
    polls = [(o, 1000 * last + s, "moving" if o == 4 and not s else f"f{o}{last}") for o in range(6) for s in (0, 40)]
    poll(spark, f"{top}/polls", polls)
    # a later poll of another owner lets the others' time pass; owner 4 has changed between its polls
    poll(spark, f"{top}/polls", [(99, 1000 * last + 65, "z")])
    if killed:
        point, library._point = library._point, lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
        with pytest.raises(Exception, match="killed"):
            run(spark, f"{top}/polls", sources, library, f"{top}/checkpoint").awaitTermination(240)
        assert library.current() == {} and files(library)
        library._point = point
    assert run(spark, f"{top}/polls", sources, library, f"{top}/checkpoint").awaitTermination(240) is not False


def names(spark, store, owner):
    return sorted(r["Name"] for r in store.read()["Tag"].filter(F.col("owner_id") == owner).collect())


def test_a_killed_job_ends_with_the_same_tables(spark, tmp_path):
    tops = [(tmp_path / n).as_uri() for n in "ab"]
    one, two = (Store(spark, f"{top}/library", sync.LIBRARY, buckets=4) for top in tops)
    a_round(spark, tops[0], one, 2)
    a_round(spark, tops[1], two, 2, killed=True)
    rows = rows_of(one)
    assert rows == rows_of(two) and len(rows["Tag"]) > 10
    # owner 5 has one snapshot, owner 99 none; owner 4 changed 25 seconds before the last poll
    state = {r["owner_id"]: r["fingerprint"] for r in one.read()["State"].collect()}
    assert state == {o: f"f{o}2" for o in range(4)}
    # what is published is the base of the next round
    a_round(spark, tops[1], two, 3)
    state = {r["owner_id"]: r["fingerprint"] for r in two.read()["State"].collect()}
    assert {o: state[o] for o in range(4)} == {o: f"f{o}3" for o in range(4)} and not {5, 99} & set(state)
    found = libraries(spark, f"{tops[1]}/again", 3).read()["Tag"]
    for o in range(4):
        both = {r["Name"] for r in found.filter(F.col("owner_id") == o).collect()} | {r.split("Name='")[1].split("'")[0] for r in rows["Tag"] if f"owner_id={o}," in r}
        assert names(spark, two, o) == sorted(both)
    runs = two.read()["Run"].collect()
    assert all(r["ok"] and r["missing"] == 0 for r in runs) and {r["owner_id"] for r in runs} == set(state)
    assert max(r["at"] for r in runs) > min(r["at"] for r in runs) and set(TABLES) <= set(rows)

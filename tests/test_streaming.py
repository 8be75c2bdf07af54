"""Streams give what the batch operators give."""

from snapfold.operators import incremental
from snapfold.streaming import jobs


def files(spark, path, rows, schema):
    for i in range(2):
        spark.createDataFrame(rows[i::2] if i else rows[::2], schema).coalesce(1).write.mode("append").parquet(path)


def test_settle_stream(spark, tmp_path):
    polls = [(o, p, f"f{(o * p * 7 // 3) % 3}", (o + p) % 4 != 0) for o in range(3) for p in range(12)]
    schema = "owner_id long, poll long, fingerprint string, merge_ok boolean"
    frame = spark.createDataFrame(polls, schema)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.settle_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    key = lambda df: sorted((r["owner_id"], r["poll"], r["merge"]) for r in df.collect())
    assert key(spark.table("settled")) == key(incremental.settle(frame))
    assert any(m for _, _, m in key(spark.table("settled")))


def test_merge_stream_is_given_changed_owners(spark, tmp_path):
    files(spark, str(tmp_path / "in"), [(1, "a"), (1, "b"), (2, "c")], "owner_id long, name string")
    seen = []
    q = jobs.merge_stream(spark.readStream.schema("owner_id long, name string").parquet(str(tmp_path / "in")), str(tmp_path / "c"), lambda owners, n: seen.extend(r[0] for r in owners.collect()))
    q.awaitTermination(60)
    assert set(seen) == {1, 2}


def test_registry_never_goes_back(spark):
    old = spark.createDataFrame([(1, "phone", "2026-05", 10, 10)], "owner_id long, device string, last_modified string, first_seen long, seen_at long")
    new = spark.createDataFrame([(1, "phone", "2026-01", 20), (1, "pad", "2026-02", 21)], "owner_id long, device string, last_modified string, seen_at long")
    got = {r["device"]: (r["last_modified"], r["first_seen"], r["seen_at"]) for r in jobs.registry_update(old, new).collect()}
    assert got == {"phone": ("2026-05", 10, 20), "pad": ("2026-02", 21, 21)}

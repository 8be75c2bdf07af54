"""Rows of one snapshot with the same identity are each reported once."""

import duckdb

from snapfold.plans.queries import ORACLES, QUERIES


def test_same_hash_twice_in_a_snapshot(spark, tmp_path):
    # owner 0, snapshot 0; the merged library lacks rows whose number ends in 0 or 1
    docs = [(0, "same"), (160, "same"), (320, "same"), (32, "other"), (480, "own")]
    spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["v5_missing_media"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({ORACLES['v5_missing_media']}) x").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(r.row_ord for r in got.collect()) == [0, 160, 320, 480]

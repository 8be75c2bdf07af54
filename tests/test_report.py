"""Reports name every conflict and every owner."""

import json

from snapfold.operators import report


def test_all_conflicts_and_owners_are_reported(spark):
    counts = spark.createDataFrame([(1, 1, "UserMark", 1, 0, 0, 0)], "owner_id long, seq int, table string, " + ", ".join(f"{a} long" for a in report.ACTIONS))
    conflicts = spark.createDataFrame([(o, 1, "InputField", f"d{k:03}", "kept") for o, n in ((1, 25), (2, 3)) for k in range(n)], "owner_id long, seq int, table string, detail string, resolution string")
    totals = spark.createDataFrame([(3, "UserMark", 1, 2)], "owner_id long, table string, before long, after long")
    got = {(r["owner_id"], r["part"]): json.loads(r["report"]) for r in report.report_json(counts, conflicts, totals, limit=10).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    assert [c["detail"] for p in range(3) for c in got[1, p]["conflicts"]] == [f"d{k:03}" for k in range(25)]
    assert (got[1, 0]["n_conflicts"], got[2, 0]["n_conflicts"], got[3, 0]["n_conflicts"]) == (25, 3, 0)

"""The merge on bucketed tables: no step moves rows, and it gives what the spread merge gives, also for giant owners."""

import random

from snapfold.operators import resolve
from snapfold.plans import jobs
from snapfold.schema import KEY, TABLES
from snapfold.sources.together import Together


def random_library(spark, rnd):
    """Small tables with ids that fit, of three owners and snapshots each."""
    out = {}
    for name in ("Location", "UserMark", "BlockRange", "Tag", "TagMap", "Note", "InputField"):
        columns, rows = [c.split() for c in TABLES[name].split(", ")], []
        for owner in range(3):
            for seq in range(3):
                for i in range(1, 9):
                    value = {c: (rnd.randint(0, 3) if kind == "long" else rnd.choice("abc")) for c, kind in columns}
                    value |= {columns[0][0]: i} | {c: rnd.randint(1, 8) for c, _ in columns[1:] if c.endswith("Id") and c != "DocumentId"}
                    value |= {"Guid": f"g{rnd.randint(1, 9)}s{seq if i % 2 else 0}i{i}", "UserMarkGuid": f"m{i}x{seq if i % 3 == 0 else 0}", "Position": i}
                    if name == "Location":
                        value |= {"BookNumber": i if i < 5 else None, "DocumentId": 10 * seq + i, "Track": None if i < 3 else i}
                    rows.append((owner, seq, i, *(value[c] for c, _ in columns)))
        out[name] = spark.createDataFrame(rows, f"{KEY}, {TABLES[name]}")
    return out


def contents(done):
    rows = {n: sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect()))) for n, df in done.tables.items()}
    return rows, sorted(map(repr, done.decisions.select("owner_id", "seq", "table", "row_ord", "action").collect()))


def test_no_step_moves_rows(spark, monkeypatch):
    tables, moved = random_library(spark, random.Random(3)), []
    members = spark.createDataFrame([], "owner_id long, seq int, member string")
    hold, enter = Together.hold, Together.enter

    def counted(self, df):
        moved.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return hold(self, df)

    monkeypatch.setattr(Together, "hold", counted)
    done = jobs.merge_together(tables, members, "now", buckets=4)
    # over all steps not more exchanges than there are tables: those that enter, and a few lists of owners and folded places
    assert sum(moved) <= len(TABLES) and len(moved) > 25
    monkeypatch.setattr(Together, "hold", hold)
    assert Together.enter is enter
    spread = jobs.merge_all(tables, members, "now")
    assert contents(done) == contents(spread)
    giant = jobs.merge_together(tables, members, "now", buckets=4, giant_rows=10)
    assert contents(giant) == contents(spread)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_sparse_ids_are_numbered_in_even_ranges(spark):
    rnd = random.Random(4)
    rows = sorted((1 if rnd.random() < 0.9 else 2, rnd.randint(1, 2), rnd.randint(-(2**62), 2**62)) for _ in range(20_000))
    df = spark.createDataFrame(rows, "owner_id long, seq int, row_ord long").repartition(8)
    got = resolve.number_rows(df, ["owner_id"], ["seq", "row_ord"])
    want = [n for owner in (1, 2) for n in range(1, sum(r[0] == owner for r in rows) + 1)]
    assert [r["number"] for r in sorted(got.collect(), key=lambda r: (r["owner_id"], r["seq"], r["row_ord"]))] == want
    sizes = sorted(r["count"] for r in df.repartitionByRange("owner_id", "seq", "row_ord").groupBy(resolve.F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]

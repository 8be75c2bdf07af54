"""Verification and integrity checks in one pass each, against plain Python."""

import random
from collections import Counter

from snapfold.operators import incremental, verify
from snapfold.plans import jobs
from snapfold.schema import REFERENCES, TABLES


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def random_tables(spark, rnd):
    """Merged tables with small ids, so that many references fit and many don't."""
    out = {}
    for name, spec in TABLES.items():
        columns = [c.split() for c in spec.split(", ")]
        value = lambda kind: None if rnd.random() < 0.1 else rnd.randint(0, 12) if kind == "long" else rnd.choice(["", "a", "b", "v1"])
        rows = [(rnd.randint(1, 3), *(value(kind) for _, kind in columns)) for _ in range(15)]
        out[name] = spark.createDataFrame(rows, f"owner_id long, {spec}")
    return out


def test_references_and_unique_keys(spark):
    tables = random_tables(spark, random.Random(6))
    rows = {n: [r.asDict() for r in df.collect()] for n, df in tables.items()}
    want = Counter()
    for child, column, parent, target in REFERENCES:
        there = {(r["owner_id"], str(r[target])) for r in rows[parent] if r[target] is not None}
        want.update((r["owner_id"], child, column, parent, str(r[column])) for r in rows[child] if r[column] is not None and (r["owner_id"], str(r[column])) not in there)
    found = verify.broken_references(tables)
    assert exchanges(found) == 1 and {tuple(r)[:5]: r["rows"] for r in found.collect()} == want
    twice = Counter()
    for table, keys in verify.UNIQUES.items():
        for key in keys:
            if all(c in rows[table][0] for c in key):
                n = Counter((r["owner_id"], *(r[c] for c in key)) for r in rows[table] if all(r[c] is not None for c in key))
                for k, x in n.items():
                    twice[k[0], table, f"unique: {', '.join(key)}"] += x if x > 1 else 0
    broken = verify.violations(tables)
    # one for the digests of all keys, one for the sums
    assert exchanges(broken) <= 2
    got = {tuple(r)[:3]: r["rows"] for r in broken.collect() if r["rule"].startswith("unique") and "(" not in r["rule"]}
    assert got == {k: n for k, n in twice.items() if n}


def test_all_items_in_one_pass(spark):
    tables = {n: df.withColumn("seq", verify.F.lit(1)) for n, df in random_tables(spark, random.Random(7)).items()}
    merged = {n: df.filter("owner_id < 3").drop("seq") for n, df in tables.items()}
    parts = [verify.missing_simple(n, tables[n], merged[n]) for n in verify.SIMPLE]
    parts += [verify.missing_locations(tables["Location"], merged["Location"]), verify.missing_items(tables, merged)]
    parts += [verify.missing_bookmarks(tables["Bookmark"], tables["Location"], merged["Bookmark"], merged["Location"])]
    parts += [verify.missing_answers(tables["InputField"], tables["Location"], merged["InputField"], merged["Location"])]
    plain = lambda dfs: sorted(map(repr, (r for df in dfs for r in df.collect())))
    whole = jobs.verify_all(tables, merged)
    # identities are looked up in one window; the rest brings places and contents to their rows
    assert whole._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(owner_id#") >= 1
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    assert plain([whole]) == plain(parts) and {r["owner_id"] for r in whole.collect()} == {3}


def test_fingerprints_are_of_sets(spark):
    rnd = random.Random(8)
    files = [(o, f"f{rnd.randint(0, 50)}", rnd.randint(0, 3), rnd.randint(0, 3)) for o in range(6) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "owner_id long, name string, size long, mtime long")
    of = lambda rows: {r["owner_id"]: r["fingerprint"] for r in incremental.fingerprints(frame(rows)).collect()}
    one = of(files)
    again = files * 2
    rnd.shuffle(again)
    assert of(again) == one and len(set(one.values())) == 6
    o, name, size, mtime = files[0]
    changed = [(a, b, c + (a == o and (b, c, d) == (name, size, mtime)), d) for a, b, c, d in files]
    assert {k for k, v in of(changed).items() if one[k] != v} == {o}
    assert of([(9, None, None, None)]) != of([(9, "", None, None)]) and of([]) == {}

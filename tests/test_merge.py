"""Rules of the merge: scenarios, and random libraries against a one-by-one fold in plain Python."""

import random

import pytest

from snapfold.operators import merge, ordering, playlist, resolve, verify
from snapfold.plans import jobs
from snapfold.schema import KEY, LOCATION_IDENTITY, TABLES


def table(spark, name, rows):
    """rows: (seq, values by column); row_ord is the first integer column."""
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    out = []
    for n, (seq, values) in enumerate(rows):
        first = values.get(columns[0])
        out.append((1, seq, first if isinstance(first, int) and name != "InputField" else n, *(values.get(c) for c in columns)))
    return spark.createDataFrame(out, f"{KEY}, {TABLES[name]}")


def ids(spark, pairs):
    return spark.createDataFrame([(1, s, a, b) for s, a, b in pairs], "owner_id long, seq int, src_id long, target_id long")


def actions(merged):
    return sorted((r["seq"], r["row_ord"], r["action"]) for r in merged.decisions.collect())


def test_tags(spark):
    rows = [(0, {"TagId": 1, "Type": 0, "Name": "Favorite"}), (0, {"TagId": 2, "Type": 1, "Name": "walks"}), (1, {"TagId": 1, "Type": 0, "Name": "Favorite"}), (1, {"TagId": 7, "Type": 1, "Name": "recipes"}), (2, {"TagId": 3, "Type": 2, "Name": "recipes"})]
    done = merge.merge_tags(table(spark, "Tag", rows))
    assert sorted((r["TagId"], r["Type"], r["Name"]) for r in done.rows.collect()) == [(1, 0, "Favorite"), (2, 1, "walks"), (3, 1, "recipes"), (4, 2, "recipes")]
    assert actions(done) == [(1, 1, "reused"), (1, 7, "added"), (2, 3, "added")]


def note(seq, content, stamp, guid="g", i=1):
    return seq, {"NoteId": i, "Guid": guid, "Title": "t", "Content": content, "LastModified": stamp, "Created": f"c{seq}", "BlockType": 0}


@pytest.mark.parametrize("versions, final", [
    ([("old", "1"), ("new", "6")], "new"),
    ([("current", "6"), ("stale", "1")], "current"),
    ([("left", "3"), ("right", "3")], "left"),
    ([("A", "1"), ("A", "5"), ("B", "3")], "B"),
])
def test_notes(spark, versions, final):
    rows = table(spark, "Note", [note(s, text, stamp) for s, (text, stamp) in enumerate(versions)])
    got = merge.merge_notes(rows, ids(spark, []), ids(spark, [])).rows.collect()
    assert [(r["Content"], r["Created"]) for r in got] == [(final, "c0")]


def test_random_notes_fold(spark):
    rnd = random.Random(1)
    rows = [note(s, rnd.choice(["a", "b", "", None]), str(rnd.randint(1, 4)), f"g{g}", 100 * s + g) for s in range(5) for g in range(40) if rnd.random() < 0.7]
    state, want = {}, []
    for s, r in rows:
        text, old = r["Content"] or "", state.get(r["Guid"])
        if old is None:
            state[r["Guid"]] = [text, r["LastModified"], r["Created"]]
            act = "added"
        elif text == old[0] or r["LastModified"] <= old[1]:
            act = "reused"
        else:
            old[0], old[1], act = text, r["LastModified"], "updated"
        if s:
            want.append((s, r["NoteId"], act))
    done = merge.merge_notes(table(spark, "Note", rows), ids(spark, []), ids(spark, []))
    assert actions(done) == sorted(want)
    assert {r["Guid"]: [r["Content"] or "", r["LastModified"], r["Created"]] for r in done.rows.collect()} == state


def test_random_marks_and_ranges(spark):
    rnd = random.Random(2)
    marks, ranges = [], []
    for s in range(4):
        for g in range(30):
            if rnd.random() < 0.7:
                m = 1000 * s + g + 1
                marks.append((s, {"UserMarkId": m, "ColorIndex": s, "LocationId": rnd.choice([1, 1, 1, 9]), "StyleIndex": 0, "UserMarkGuid": f"g{g}", "Version": rnd.choice([None, 1, 2, 3])}))
                for e in rnd.sample(range(3), rnd.randint(1, 3)):
                    ranges.append((s, {"BlockRangeId": len(ranges) + 1, "BlockType": 1, "Identifier": 1, "StartToken": 0, "EndToken": None if e == 2 else e, "UserMarkId": m}))
    known, held, want, want_ranges, placed = {}, {}, [], [], {0: {1: 1, 9: 9}} | {s: {1: 1} for s in (1, 2, 3)}
    for s, m in marks:
        g, v = m["UserMarkGuid"], m["Version"] or 0
        if m["LocationId"] not in placed[s]:
            want.append((s, m["UserMarkId"], "skipped"))
            continue
        act = "added" if g not in known else "updated" if v > known[g][0] else "reused"
        if act != "reused":
            known[g] = (v, s)
            held[g] = []
        if s:
            want.append((s, m["UserMarkId"], act))
        for q, r in ranges:
            if (q, r["UserMarkId"]) == (s, m["UserMarkId"]):
                new = s == 0 or r["EndToken"] not in held[g]
                held[g] += [r["EndToken"]] if new else []
                if s:
                    want_ranges.append((s, r["BlockRangeId"], "added" if new else "reused"))
    done, kept = merge.merge_marks(table(spark, "UserMark", marks), table(spark, "BlockRange", ranges), ids(spark, [(s, 1, 1) for s in range(4)]))
    assert actions(done) == sorted(want) and actions(kept) == sorted(want_ranges)
    assert {r["UserMarkGuid"]: r["ColorIndex"] for r in done.rows.collect()} == {g: s for g, (_, s) in known.items()}
    guid = {r["UserMarkId"]: r["UserMarkGuid"] for r in done.rows.collect()}
    assert sorted((guid[r["UserMarkId"]], str(r["EndToken"])) for r in kept.rows.collect()) == sorted((g, str(e)) for g, es in held.items() for e in es)


def test_random_bookmarks(spark):
    rnd = random.Random(3)
    rows, n = [], 0
    for s in range(4):
        for pub in range(3):
            places = rnd.sample(range(30), rnd.randint(0, 9))
            for slot, place in zip(rnd.sample(range(10), len(places)), places):
                n += 1
                rows.append((s, {"BookmarkId": n, "LocationId": place, "PublicationLocationId": 100 + pub, "Slot": slot, "Title": "t", "BlockType": 0}))
    used, want = {}, []
    for s, r in rows:
        slots = used.setdefault(r["PublicationLocationId"], {})
        if s == 0:
            slots[r["LocationId"]] = r["Slot"]
        elif r["LocationId"] in slots:
            want.append((s, r["BookmarkId"], "reused"))
        else:
            free = sorted(set(range(10)) - set(slots.values()))
            if free:
                slots[r["LocationId"]] = free[0]
            want.append((s, r["BookmarkId"], "added" if free else "skipped"))
    same = ids(spark, [(s, i, i) for s in range(4) for i in (*range(30), 100, 101, 102)])
    done = merge.merge_bookmarks(table(spark, "Bookmark", rows), same)
    assert actions(done) == sorted(want)
    assert sorted((r["PublicationLocationId"], r["LocationId"], r["Slot"]) for r in done.rows.collect()) == sorted((p, k, v) for p, m in used.items() for k, v in m.items())


@pytest.mark.parametrize("seed", [4, 5])
def test_random_places(spark, seed):
    rnd = random.Random(seed)
    rows, n = [], 0
    for s in range(4):
        k1s, k2s = set(), set()
        for _ in range(25):
            n += 1
            v = dict.fromkeys(LOCATION_IDENTITY) | {"LocationId": n, "IssueTagNumber": 0, "KeySymbol": rnd.choice("ab"), "MepsLanguage": 1, "Type": 0, "BookNumber": rnd.choice([None, 1, 2]), "ChapterNumber": rnd.choice([None, 1]), "DocumentId": rnd.choice([None, 1, 2]), "Track": rnd.choice([None, 1]), "Specialty": rnd.choice([None, "", "x"])}
            k1, k2 = keys_of(v)
            if (k1 and k1 in k1s) or (k2 and k2 in k2s):
                continue
            k1s.add(k1), k2s.add(k2)
            rows.append((s, v))
    found, want, clash = {}, [], 0
    for s, v in rows:
        names = [("id", tuple(v[c] for c in LOCATION_IDENTITY)), *[(k, x) for k, x in zip(("k1", "k2"), keys_of(v)) if x]]
        hit = next((x for x in names if x in found), None)
        if s == 0 or hit is None:
            for x in names:
                found[x] = (s, v["LocationId"]) if x not in found or (s == 0 and x[0] == "id") else found[x]
            if s:
                want.append((s, v["LocationId"], "added"))
        else:
            want.append((s, v["LocationId"], "reused"))
            clash += hit[0] != "id"
    done = merge.merge_locations(table(spark, "Location", rows))
    assert actions(done) == sorted(want)
    assert done.conflicts.count() == clash


def keys_of(v):
    k1 = (v["BookNumber"], v["ChapterNumber"], v["KeySymbol"])
    k2 = (v["KeySymbol"], v["DocumentId"], v["Track"], v["Specialty"] or "")
    return k1 if None not in k1 else None, k2 if None not in k2[:3] else None


def test_answers_and_tag_positions(spark):
    rows = table(spark, "InputField", [(s, {"LocationId": 1, "TextTag": "a", "Value": x}) for s, x in enumerate("xyy")])
    same = ids(spark, [(s, 1, 1) for s in range(3)])
    keep, over = merge.merge_answers(rows, same), merge.merge_answers(rows, same, overwrite=True)
    assert [r["Value"] for r in keep.rows.collect()] == ["x"] and [r["Value"] for r in over.rows.collect()] == ["y"]
    assert [a for _, _, a in actions(over)] == ["updated", "reused"] and keep.conflicts.count() == 2 and over.conflicts.count() == 1
    maps = table(spark, "TagMap", [(0, {"TagMapId": 1, "NoteId": 1, "TagId": 1, "Position": 0}), (0, {"TagMapId": 2, "NoteId": 2, "TagId": 1, "Position": 1}), (1, {"TagMapId": 1, "NoteId": 3, "TagId": 1, "Position": 0}), (1, {"TagMapId": 2, "NoteId": 8, "TagId": 1, "Position": 1})])
    none = ids(spark, [])
    done = merge.merge_tag_maps(maps, ids(spark, [(1, 1, 1)]), none, none, ids(spark, [(1, 3, 3)]))
    assert sorted(r["Position"] for r in done.rows.collect()) == [0, 1, 2]
    assert actions(done) == [(1, 1, "added"), (1, 2, "skipped")]


def test_numbers_cross_chunks(spark):
    rows = spark.createDataFrame([(1, s, i) for s in (1, 2) for i in range(0, 50, 7)], "owner_id long, seq int, row_ord long")
    got = resolve.number_rows(rows, ["owner_id"], ["seq", "row_ord"]).collect()
    assert [r["number"] for r in sorted(got, key=lambda r: (r["seq"], r["row_ord"]))] == list(range(1, 17))


def test_a_large_tag_is_cut_into_runs(spark):
    rows = spark.createDataFrame([(1, s, 7, p, 1000 * s + p) for s in (1, 2) for p in range(60)], "owner_id long, seq int, TagId long, Position long, row_ord long")
    order = ["seq", "TagId", "Position", "row_ord"]
    got = resolve.number_rows(rows, ["owner_id", "TagId"], order)
    assert [r["number"] for r in sorted(got.collect(), key=lambda r: (r["seq"], r["Position"]))] == list(range(1, 121))
    runs = rows.groupBy("seq", (resolve.F.col("Position") / 10).cast("int")).count()
    assert runs.count() == 12
    base = rows.withColumn("seq", resolve.F.lit(0)).limit(0)
    done = resolve.append_position(base.unionByName(rows), "TagId", "Position", ("TagId", "Position", "row_ord"), "row_ord")
    assert sorted(r["final_position"] for r in done.collect()) == list(range(120))


def test_damage_is_reported(spark):
    notes = table(spark, "Note", [note(0, "a", "1", f"g{i}", i) for i in range(5)])
    missing = verify.missing_simple("Note", notes, notes.filter("NoteId <> 3").drop("seq"))
    assert missing.count() == 1
    assert [r["ok"] for r in verify.verdicts(notes, missing).collect()] == [False]


def test_base_choice_and_gate(spark):
    rows = spark.createDataFrame([(1, 1, 1, "", "2026-08-01", 16), (1, 2, 2, "2026-01-01", "x", 16), (2, 3, 3, "2026-01-01", "", 16), (2, 4, 4, "2026-02-01", "", 15)], "owner_id long, snapshot_id long, input_ord long, last_modified string, creation_date string, schema_version long")
    good, bad = ordering.version_gate(ordering.with_seq(rows))
    assert sorted((r["snapshot_id"], r["seq"]) for r in good.collect()) == [(1, 0), (2, 1)]
    assert [(r["snapshot_id"], r["base_version"]) for r in bad.collect()] == [(3, 15)]
    assert playlist is not None and jobs is not None

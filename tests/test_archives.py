"""Archives are read into tables, written back, and damaged ones reported."""

import io
import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from snapfold.functions import keys
from snapfold.schema import TABLES
from snapfold.sources import archives


def build(path, tags, prefix="", manifest=True, broken=False):
    db = path.parent / f"{path.stem}.sqlite"
    con = sqlite3.connect(db)
    for name, spec in TABLES.items():
        con.execute(f'create table "{name}" ({", ".join(c.split()[0] for c in spec.split(", "))})')
    con.executemany("insert into Tag values (?, ?, ?)", tags)
    con.execute("insert into LastModified values ('2026-01-01T00:00:00Z')")
    con.execute("insert into grdb_migrations values ('v16')")
    con.commit()
    con.close()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(prefix + ("other.db" if broken else archives.DATABASE), db.read_bytes())
        z.writestr(prefix + "song.mp3", b"abc")
        if manifest:
            z.writestr(prefix + archives.MANIFEST, json.dumps({"name": "n", "creationDate": "d", "version": 1, "type": 0, "odd": "kept", "userDataBackup": {"lastModifiedDate": "2026-02-01", "deviceName": "phone", "databaseName": archives.DATABASE, "hash": "", "schemaVersion": 16, "more": "too"}}))
    db.unlink()


def test_read_scan_and_write(spark, tmp_path):
    build(tmp_path / "a.lib", [(1, 0, "x"), (2, 1, "y")])
    build(tmp_path / "b.lib", [(5, 1, "z")], prefix="inner/", manifest=False)
    build(tmp_path / "c.lib", [], broken=True)
    (tmp_path / "d.lib").write_bytes(b"no zip")
    parsed = archives.read_archives(spark, str(tmp_path)).cache()
    found = {r["path"].split("/")[-1]: r for r in archives.scan(parsed).collect()}
    assert (found["a.lib"]["device"], found["b.lib"]["device"], found["b.lib"]["schema_version"]) == ("phone", "b", 16)
    assert found["c.lib"]["error"] and found["d.lib"]["error"] and not found["a.lib"]["error"]
    order = parsed.filter("kind = 'user_version'").select("path", F.lit(1).alias("owner_id"), F.when(F.col("path").endswith("a.lib"), 0).otherwise(1).alias("seq"))
    tags = archives.table_rows(parsed, "Tag", order)
    assert sorted((r["seq"], r["row_ord"], r["Name"]) for r in tags.collect()) == [(0, 1, "x"), (0, 2, "y"), (1, 5, "z")]
    assert archives.members(parsed, order).filter("member = 'song.mp3'").count() == 2
    m = parsed.filter("kind = 'manifest'").select(archives.parse_manifest(F.col("payload")).alias("m"))
    assert m.first()["m"]["extra"] == {"odd": "kept"} and m.first()["m"]["backup_extra"] == {"more": "too"}
    text = m.select(archives.write_manifest(F.col("m")).alias("j"))
    again = text.select(archives.parse_manifest(F.col("j")).alias("m")).first()["m"]
    assert again["device_name"] == "phone" and again["schema_version"] == 16
    assert again["extra"] == {"odd": "kept"} and again["backup_extra"] == {"more": "too"}

    out = archives.archive_bytes({"Tag": tags.drop("seq", "row_ord")}, spark.createDataFrame([(1, "{}")], "owner_id long, manifest string"))
    archives.write_archives(out, str(tmp_path / "out"), ".lib")
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out/1.lib").read_bytes())) as z:
        (tmp_path / "back.db").write_bytes(z.read(archives.DATABASE))
    assert sqlite3.connect(tmp_path / "back.db").execute("select TagId, Name from Tag order by 1").fetchall() == [(1, "x"), (2, "y"), (5, "z")]
    assert sqlite3.connect(tmp_path / "back.db").execute("pragma user_version").fetchone() == (16,)
    assert not list((tmp_path / "out").glob("*.part"))


def test_short_hex(spark):
    rows = spark.createDataFrame([("a8090d0802",), ("ff0010",)], "h string")
    assert [r[0] for r in rows.select(keys.short_hex(F.col("h"))).collect()] == ["a89d82", "ff010"]


def library(path, device, shift, media):
    """An archive with the whole schema: a place, a highlight with a range, a note, tags, an item with a thumbnail."""
    db = path.parent / f"{path.stem}.sqlite"
    con = sqlite3.connect(db)
    for name in TABLES:
        con.execute(archives.table_ddl(name))
    for statement in archives.index_ddl():
        con.execute(statement)
    s = shift
    put = lambda table, *row: con.execute(f'insert into "{table}" values ({", ".join("?" * len(row))})', row)
    put("Location", 1 + s, 1, 1, None, None, 0, "sym", 0, 0, "same place", None, None)
    put("Location", 2 + s, None, None, 70 + s, None, 0, "sym", 0, 0, f"place of {device}", None, None)
    put("UserMark", 1 + s, 1, 1 + s, 0, "mark", 1 + s)
    put("BlockRange", 1 + s, 1, 3, s, 9, 1 + s)
    put("Note", 1 + s, "note", 1 + s, 2 + s, "t", f"text of {device}", f"2025-0{1 + s}-01T00:00:00Z", "2025-01-01T00:00:00Z", 0, None)
    put("Bookmark", 1 + s, 2 + s, 1 + s, 0, "b", None, 0, None)
    put("InputField", 1 + s, "q", f"answer of {device}")
    put("Tag", 1 + s, 1, "both"), put("Tag", 2 + s, 2, "list")
    put("IndependentMedia", 1 + s, "f", "pic.jpg", "image/jpeg", keys_hash(media))
    put("PlaylistItemAccuracy", 1 + s, "fine")
    put("PlaylistItem", 1 + s, "item", None, None, 1 + s, 0, "pic.jpg")
    put("PlaylistItemIndependentMediaMap", 1 + s, 1 + s, 5), put("PlaylistItemLocationMap", 1 + s, 1 + s, 1, None)
    put("PlaylistItemMarker", 1 + s, 1 + s, "m", 0, 1, 0), put("PlaylistItemMarkerBibleVerseMap", 1 + s, 4), put("PlaylistItemMarkerParagraphMap", 1 + s, 1, 2, 3)
    put("TagMap", 1 + s, None, None, 1 + s, 1 + s, 0), put("TagMap", 2 + s, 1 + s, None, None, 2 + s, 0)
    put("LastModified", f"2026-01-0{1 + s}T00:00:00Z"), put("grdb_migrations", "v16")
    con.execute("pragma user_version = 16")
    con.commit()
    con.close()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(archives.DATABASE, db.read_bytes())
        z.writestr("pic.jpg", media)
        z.writestr(archives.MANIFEST, json.dumps({"name": device, "creationDate": "d", "version": 1, "type": 0, "userDataBackup": {"lastModifiedDate": f"2026-01-0{9 - s}", "deviceName": device, "databaseName": archives.DATABASE, "hash": "", "schemaVersion": 16}}))
    db.unlink()


def keys_hash(data):
    import hashlib

    return "".join(f"{x:x}" for x in hashlib.sha256(data).digest())


def test_archives_to_tables_to_merge_to_archive_and_back(spark, tmp_path):
    from snapfold.operators import ordering, verify
    from snapfold.plans import jobs
    from snapfold.sources import tables

    (tmp_path / "in").mkdir()
    for shift, device in enumerate(("phone", "tablet", "desk")):
        library(tmp_path / "in" / f"{device}.lib", device, shift, b"same" if shift < 2 else b"other picture")
    parsed = archives.read_archives(spark, str(tmp_path / "in")).cache()
    found = archives.snapshots(parsed).withColumns({"owner_id": F.lit(5).cast("long"), "snapshot_id": F.lit(1), "input_ord": F.col("path")})
    order = ordering.with_seq(found)
    assert [r["device"] for r in order.orderBy("seq").collect()] == ["phone", "tablet", "desk"]
    tables.write_tables({n: archives.table_rows(parsed, n, order) for n in TABLES}, str(tmp_path / "work"))
    t = tables.read_tables(spark, str(tmp_path / "work"))
    plain = lambda rows: sorted(map(str, rows.collect()))
    assert all(plain(archives.table_rows(parsed, n, order)) == plain(t[n]) for n in TABLES)
    members = archives.members(parsed, order)
    media = ordering.media_members(members).select("owner_id", "seq", "member")
    done = jobs.merge_all(t, media, "2026-05-05T00:00:00Z")
    tables.write_tables(done.tables, str(tmp_path / "merged"), keyed=False)
    merged = tables.read_tables(spark, str(tmp_path / "merged"), keyed=False)
    assert verify.broken_references(merged).count() == 0 and verify.violations(merged).count() == 0

    plan = done.media_plan.join(order.select("owner_id", "seq", "path"), ["owner_id", "seq"])
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    manifest = parsed.filter("kind = 'manifest' and path like '%phone.lib'").select(F.lit(5).cast("long").alias("owner_id"), F.col("payload").alias("manifest"))
    archives.write_archives(archives.archive_bytes(merged, manifest, archives.member_bytes(files, plan)), (tmp_path / "out").as_uri(), ".lib")
    again = archives.read_archives(spark, str(tmp_path / "out")).cache()
    assert again.filter("kind = 'error'").count() == 0
    one = again.filter("kind = 'user_version'").select("path", F.lit(5).alias("owner_id"), F.lit(0).alias("seq"))
    for n in TABLES:
        assert plain(archives.table_rows(again, n, one).drop("seq", "row_ord")) == plain(merged[n]), n
    with zipfile.ZipFile(tmp_path / "out/5.lib") as z:
        data = z.read(archives.DATABASE)
        (tmp_path / "back.db").write_bytes(data)
        names = sorted(set(z.namelist()) - {archives.DATABASE, archives.MANIFEST})
        held = {keys_hash(z.read(n)): n for n in names}
        assert json.loads(z.read(archives.MANIFEST))["userDataBackup"]["hash"] == keys_hash(data)
    con = sqlite3.connect(tmp_path / "back.db")
    assert con.execute("pragma foreign_key_check").fetchall() == [] and con.execute("pragma integrity_check").fetchall() == [("ok",)]
    # the other picture had the same path, so it has a name of its own; each hash leads to its bytes
    assert len(names) == 2 and dict(con.execute("select Hash, FilePath from IndependentMedia").fetchall()) == held
    assert con.execute("select count(*) from Note").fetchone() == (1,) and con.execute("select Content from Note").fetchone() == ("text of desk",)
    for bad in ("insert into Tag values (99, 1, 'both')", "insert into Tag values (99, 9, 'x')", "insert into Location values (99, 1, 1, null, null, 0, 'sym', 0, 0, '', null, null)", "insert into Note values (99, null, null, null, '', '', '', '', 0, null)"):
        try:
            con.execute(bad)
        except sqlite3.IntegrityError:
            continue
        raise AssertionError(bad)

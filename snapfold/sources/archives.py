"""Snapshot archives (a ZIP of an SQLite file, a manifest and media files) as rows, and merged libraries as archives.

Archives are read through Spark's binaryFile source and parsed one at a time by standard-library helpers; an unreadable
one becomes an error row and stops nothing. Reading takes only names and sizes of media; their bytes move once, when a merged
library is written.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.functions.keys import file_name, migration_version, stem
from snapfold.operators.verify import CHECKS, REQUIRED, UNIQUES
from snapfold.schema import KEY, REFERENCES, TABLES, has_id

DATABASE, MANIFEST = "userData.db", "manifest.json"
PARSED = "path string, kind string, name string, row_ord long, payload string, size long"
BACKUP_FIELDS = ("databaseName", "deviceName", "hash", "lastModifiedDate", "schemaVersion")
TOP_FIELDS = ("creationDate", "name", "type", "userDataBackup", "version")


def discover(listing: DataFrame, outputs: DataFrame, suffix: str) -> DataFrame:
    """Files of a listing (owner_id, name, ...) that are inputs: the suffix, no dot-file, no earlier output of ours."""
    inputs = listing.filter(F.col("name").endswith(suffix) & ~F.col("name").startswith("."))
    return inputs.join(outputs.select("owner_id", "name"), ["owner_id", "name"], "left_anti").select(*listing.columns)


def pending(listing: DataFrame, suffix: str, cloud: str = ".icloud") -> DataFrame:
    """Names of files that a cloud folder has yet to download: its placeholders without the dot and its suffix."""
    end = suffix + cloud
    return listing.filter(F.col("name").startswith(".") & F.col("name").endswith(end)).withColumn("name", F.expr(f"substring(name, 2, length(name) - {len(cloud) + 1})"))


def _prefix(names: list[str]) -> str:
    """The folder of the database, which is at the top or one folder down."""
    found = [n for n in names if n.split("/")[-1] == DATABASE and n.count("/") <= 1]
    if not found:
        raise ValueError(f"no {DATABASE} in the archive")
    return min(found, key=lambda n: n.count("/"))[: -len(DATABASE)]


def _parse(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [n for n in archive.namelist() if not n.endswith("/")]
        for n in names:
            if n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") or ":" in n.split("/")[0]:
                raise ValueError(f"unsafe member {n}")
        prefix = _prefix(names)
        own = {n[len(prefix) :]: n for n in names if n.startswith(prefix)}
        for name, member in sorted(own.items()):
            yield "member", name, 0, None, archive.getinfo(member).file_size
        if MANIFEST in own:
            yield "manifest", MANIFEST, 0, archive.read(own[MANIFEST]).decode(), 0
        with tempfile.TemporaryDirectory() as folder:
            # a write-ahead log beside the database is applied by the standard library when it opens the pair
            for name in own:
                if name == DATABASE or name in (f"{DATABASE}-wal", f"{DATABASE}-shm"):
                    with open(os.path.join(folder, name), "wb") as f:
                        f.write(archive.read(own[name]))
            db = sqlite3.connect(os.path.join(folder, DATABASE))
            try:
                have = {r[0] for r in db.execute("select name from sqlite_master where type = 'table'")}
                if not {"LastModified", "Location"} <= have:
                    raise ValueError("not a library database")
                yield "user_version", "", 0, str(db.execute("pragma user_version").fetchone()[0]), 0
                for table in sorted(have & set(TABLES)):
                    cursor = db.execute(f'select rowid, * from "{table}"')
                    columns = [c[0] for c in cursor.description][1:]
                    for place, *row in cursor:
                        # rows of a table without ids of its own are told apart by their place in it
                        ord_ = row[0] if has_id(table) and isinstance(row[0], int) else place
                        yield "row", table, ord_, json.dumps(dict(zip(columns, row))), 0
            finally:
                db.close()


def parse_archives(files: DataFrame) -> DataFrame:
    """Rows of kind row, member, manifest, user_version or error for binaryFile rows (path, length, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, length in zip(batch["path"], batch["content"], batch["length"]):
                rows = [("file", path, 0, None, length)]
                try:
                    rows += list(_parse(bytes(content)))
                except Exception as e:  # any damage is a row of the result
                    rows.append(("error", type(e).__name__, 0, str(e), 0))
                yield pd.DataFrame([(path, *r) for r in rows], columns=[c.split()[0] for c in PARSED.split(", ")])

    return files.select("path", "length", "content").mapInPandas(run, PARSED)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return parse_archives(spark.read.format("binaryFile").load(path))


def table_rows(parsed: DataFrame, table: str, order: DataFrame) -> DataFrame:
    """One table; order gives path, owner_id and seq of each archive."""
    rows = parsed.filter((F.col("kind") == "row") & (F.col("name") == table)).join(order.select("path", "owner_id", "seq"), "path")
    typed = rows.withColumn("r", F.from_json("payload", TABLES[table]))
    return typed.select(F.col("owner_id").cast("long").alias("owner_id"), F.col("seq").cast("int").alias("seq"), "row_ord", "r.*").to(SparkSession.active().createDataFrame([], f"{KEY}, {TABLES[table]}").schema)


def members(parsed: DataFrame, order: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'member'").join(order.select("path", "owner_id", "seq"), "path").select("owner_id", "seq", F.col("name").alias("member"), "size")


def parse_manifest(payload: Column) -> Column:
    """Known fields of a manifest, and the unknown ones of both levels: shown as text, and held as they are in VARIANT values."""
    known = F.from_json(payload, "name string, creationDate string, version long, type long, userDataBackup struct<lastModifiedDate:string,deviceName:string,databaseName:string,hash:string,schemaVersion:long>")
    top, inner = F.from_json(payload, "map<string,string>"), F.from_json(F.get_json_object(payload, "$.userDataBackup"), "map<string,string>")
    held, held_inner = F.from_json(payload, "map<string,variant>"), F.from_json(F.get_json_object(payload, "$.userDataBackup"), "map<string,variant>")
    rest = lambda m, names: F.map_filter(m, lambda k, _: ~k.isin(*names))
    b = known["userDataBackup"]
    return F.struct(known["name"].alias("name"), known["creationDate"].alias("creation_date"), known["version"].alias("version"), known["type"].alias("type"), b["schemaVersion"].alias("schema_version"), b["databaseName"].alias("database_name"), b["deviceName"].alias("device_name"), b["lastModifiedDate"].alias("last_modified"), b["hash"].alias("hash"), rest(top, TOP_FIELDS).alias("extra"), rest(inner, BACKUP_FIELDS).alias("backup_extra"), rest(held, TOP_FIELDS).alias("unknown"), rest(held_inner, BACKUP_FIELDS).alias("backup_unknown"))


def _spliced(known: Column, extra: Column) -> Column:
    """JSON object `known` with the entries of the map `extra` behind its own."""
    more = F.substring(F.to_json(extra), 2, 1 << 30)
    return F.when(F.size(extra) > 0, F.concat(F.regexp_replace(known, r"\}$", ","), more)).otherwise(known)


def write_manifest(m: Column) -> Column:
    """JSON of a manifest struct; unknown fields of any depth are written back as they were."""
    backup = F.to_json(F.struct(m["last_modified"].alias("lastModifiedDate"), m["device_name"].alias("deviceName"), m["database_name"].alias("databaseName"), m["hash"].alias("hash"), m["schema_version"].alias("schemaVersion")))
    top = F.to_json(F.struct(m["name"].alias("name"), m["creation_date"].alias("creationDate"), m["version"].alias("version"), m["type"].alias("type")))
    whole = F.concat(F.regexp_replace(top, r"\}$", ',"userDataBackup":'), _spliced(backup, m["backup_unknown"]), F.lit("}"))
    return _spliced(whole, m["unknown"])


def snapshots(parsed: DataFrame) -> DataFrame:
    """One row for each readable archive: from its manifest, else from its database and file name."""
    m = parsed.filter("kind = 'manifest'").select("path", parse_manifest(F.col("payload")).alias("m"))
    of = lambda table, field: parsed.filter((F.col("kind") == "row") & (F.col("name") == table)).select("path", F.get_json_object("payload", f"$.{field}").alias(field))
    migration = of("grdb_migrations", "identifier").groupBy("path").agg(F.max(migration_version(F.col("identifier"))).alias("from_migrations"))
    modified = of("LastModified", "LastModified").groupBy("path").agg(F.max("LastModified").alias("from_table"))
    version = parsed.filter("kind = 'user_version'").select("path", F.nullif(F.col("payload").cast("long"), F.lit(0)).alias("user_version"))
    out = version.join(m, "path", "left").join(migration, "path", "left").join(modified, "path", "left")
    return out.select("path", F.coalesce("m.device_name", stem(F.col("path"))).alias("device"), F.coalesce("m.schema_version", "user_version", "from_migrations").alias("schema_version"), F.coalesce("m.last_modified", "from_table").alias("last_modified"), F.coalesce("m.creation_date", F.lit("")).alias("creation_date"), F.coalesce("m.name", file_name(F.col("path"))).alias("name"))


def scan(parsed: DataFrame) -> DataFrame:
    """One row for each file: device, schema version, last modified, size in MB with a decimal, and the error if any."""
    files = parsed.filter("kind = 'file'").select("path", F.round(F.col("size") / 1e6, 1).alias("size_mb"))
    errors = parsed.filter("kind = 'error'").select("path", F.col("payload").alias("error"))
    return files.join(snapshots(parsed).select("path", "device", "schema_version", "last_modified"), "path", "left").join(errors, "path", "left")


def table_ddl(table: str, version: int = 16) -> str:
    """CREATE TABLE with the types, keys, checks and references of the schema."""
    columns = [c.split() for c in TABLES[table].split(", ")]
    names = [c for c, _ in columns]
    own = [k for k in UNIQUES.get(table, ()) if all(c in names for c in k)]
    primary = own[0] if own and table not in ("LastModified",) else ()
    integer_key = len(primary) == 1 and dict(columns)[primary[0]] == "long"
    parts = []
    for c, kind in columns:
        never_null = c in REQUIRED.get(table, ()) or c in primary
        parts.append(f'"{c}" {"INTEGER" if kind == "long" else "TEXT"}{" NOT NULL" if never_null else ""}{" PRIMARY KEY" if integer_key and c == primary[0] else ""}')
    quoted = lambda k: ", ".join(f'"{c}"' for c in k)
    if primary and not integer_key:
        parts.append(f"PRIMARY KEY ({quoted(primary)})")
    parts += [f"UNIQUE ({quoted(k)})" for k in own[1:]]
    parts += [f"CHECK ({rule})" for _, rule in CHECKS.get(table, ())]
    parts += [f'FOREIGN KEY ("{c}") REFERENCES "{p}" ("{to}")' for child, c, p, to in REFERENCES if child == table]
    return f'CREATE TABLE "{table}" ({", ".join(parts)})'


def index_ddl() -> list[str]:
    """Unique keys over expressions, and an index for each reference."""
    out = [f'CREATE UNIQUE INDEX "IX_{t}_{i}" ON "{t}" ({", ".join(k)})' for t, keys in UNIQUES.items() for i, k in enumerate(keys) if any("(" in c for c in k)]
    return out + [f'CREATE INDEX "IX_{t}_{c}" ON "{t}" ("{c}")' for t, c in dict.fromkeys((r[0], r[1]) for r in REFERENCES)]


def member_bytes(files: DataFrame, plan: DataFrame) -> DataFrame:
    """owner_id, name, content of the media that a plan (owner_id, member, path, from_member) takes from archives.

    files: binaryFile rows (path, content); each archive is opened once, and only what is taken leaves it.
    """
    wanted = plan.groupBy("path").agg(F.collect_list(F.struct("owner_id", "member", "from_member")).alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, rows in zip(batch["content"], batch["wanted"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    inner = {n.removeprefix(_prefix(z.namelist())): n for n in z.namelist()}
                    for r in rows:
                        yield pd.DataFrame({"owner_id": [r["owner_id"]], "name": [r["member"]], "content": [z.read(inner[r["from_member"]])]})

    return files.select("path", "content").join(wanted, "path").select("content", "wanted").mapInPandas(run, "owner_id long, name string, content binary")


def archive_bytes(tables: dict[str, DataFrame], manifests: DataFrame, media: DataFrame | None = None, version: int = 16, hash_mode: str = "sha256") -> DataFrame:
    """owner_id and the bytes of an archive of each merged library.

    manifests: owner_id, manifest (JSON); media: owner_id, name, content (see member_bytes). The database has the whole
    schema. hash_mode sha256 puts its SHA-256, in the short hex form, into the manifest, empty an empty text, and keep leaves the
    one there. A library is one person's and fits a task.
    """
    if hash_mode not in ("sha256", "keep", "empty"):
        raise ValueError(f"unknown hash_mode {hash_mode}")
    parts = [df.select("owner_id", F.lit(n).alias("name"), F.to_json(F.struct(*(c for c in df.columns if c != "owner_id")), {"ignoreNullFields": "false"}).cast("binary").alias("payload"), F.lit(False).alias("file")) for n, df in tables.items()]
    parts.append(manifests.select("owner_id", F.lit(MANIFEST).alias("name"), F.col("manifest").cast("binary").alias("payload"), F.lit(False).alias("file")))
    if media is not None:
        parts.append(media.select("owner_id", "name", F.col("content").alias("payload"), F.lit(True).alias("file")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, DATABASE)
            db = sqlite3.connect(path)
            db.execute(f"pragma user_version = {version}")
            own = group[~group["file"]]
            for table, spec in TABLES.items():
                columns = [c.split()[0] for c in spec.split(", ")]
                db.execute(table_ddl(table))
                values = [json.loads(bytes(p)) for p in own.loc[own["name"] == table, "payload"]]
                values.sort(key=lambda r: [(x is not None, x if isinstance(x, int) else 0, str(x)) for x in (r.get(c) for c in columns)])
                db.executemany(f'insert into "{table}" values ({", ".join("?" * len(columns))})', [[r.get(c) for c in columns] for r in values])
            for statement in index_ddl():
                db.execute(statement)
            db.commit()
            broken = db.execute("pragma foreign_key_check").fetchall()
            db.close()
            if broken:
                raise ValueError(f"owner {group['owner_id'].iloc[0]}: {len(broken)} broken references, such as {broken[0]}")
            with open(path, "rb") as f:
                content = f.read()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for payload in own.loc[own["name"] == MANIFEST, "payload"]:
                manifest = json.loads(bytes(payload))
                if "userDataBackup" in manifest and hash_mode != "keep":
                    manifest["userDataBackup"]["hash"] = "".join(f"{b:x}" for b in hashlib.sha256(content).digest()) if hash_mode == "sha256" else ""
                z.writestr(MANIFEST, json.dumps(manifest, ensure_ascii=False))
            z.writestr(DATABASE, content)
            for name, data in sorted(zip(group.loc[group["file"], "name"], group.loc[group["file"], "payload"])):
                z.writestr(name, bytes(data))
        return pd.DataFrame({"owner_id": [group["owner_id"].iloc[0]], "content": [out.getvalue()]})

    return rows.groupBy("owner_id").applyInPandas(build, "owner_id long, content binary")


def write_archives(archives: DataFrame, folder: str, suffix: str) -> None:
    """One file for each owner in a folder (path or URI) that all executors reach: written aside, then renamed."""
    uri = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def write(rows) -> None:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        store.create_dir(top, recursive=True)
        for r in rows:
            path = f"{top}/{r['owner_id']}{suffix}"
            with store.open_output_stream(f"{path}.part") as f:
                f.write(r["content"])
            store.move(f"{path}.part", path)

    archives.foreachPartition(write)


def write_history(rows: DataFrame, path: str, stamp: str) -> None:
    """A dated copy of a result; writing a stamp again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/run={stamp}")

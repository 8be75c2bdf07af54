"""Independent checks that every item of every snapshot is findable in the merged tables, and integrity checks.

Merged tables have owner_id; source tables have owner_id, seq and row_ord. Missing rows: owner_id, seq, table, identity,
description (cut at 40 characters).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.functions.keys import key, location_identity
from snapfold.operators.playlist import item_keys
from snapfold.schema import REFERENCES

SIMPLE = {
    "Note": (("Guid",), "Title"),
    "UserMark": (("UserMarkGuid",), "UserMarkGuid"),
    "Tag": (("Type", "Name"), "Name"),
    "IndependentMedia": (("Hash",), "OriginalFilename"),
}


def named(rows: DataFrame, table: str, identity: Column, shown: Column, *also: str) -> DataFrame:
    """owner_id, seq (0 in merged tables), table, identity (one narrow, null-safe string) and description of each row, and the
    columns of `also`."""
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    return rows.select("owner_id", seq.cast("int").alias("seq"), F.lit(table).alias("table"), identity.alias("identity"), F.substring(F.coalesce(shown.cast("string"), F.lit("")), 1, 40).alias("description"), *also)


def not_found(sources: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows of sources (see named) whose identity no merged row of the same owner and table has.

    Both sides are dealt by (owner, table, identity) once, and a flag of the merged side is looked for among equal ones.
    """
    both = sources.withColumn("_there", F.lit(0)).unionByName(merged.withColumn("_there", F.lit(1)))
    known = F.max("_there").over(W.partitionBy("owner_id", "table", "identity"))
    return both.withColumn("_known", known).filter("_known = 0").drop("_there", "_known")


def simple_names(table: str, rows: DataFrame, *also: str) -> DataFrame:
    columns, shown = SIMPLE[table]
    return named(rows, table, key(*columns), F.col(shown), *also)


def missing_simple(table: str, sources: DataFrame, merged: DataFrame) -> DataFrame:
    return not_found(simple_names(table, sources), simple_names(table, merged))


def location_names(rows: DataFrame) -> DataFrame:
    return named(rows, "Location", location_identity(), F.col("Title"))


def missing_locations(sources: DataFrame, merged: DataFrame) -> DataFrame:
    return not_found(location_names(sources), location_names(merged))


def with_place(rows: DataFrame, locations: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the identity of the place that rows.column refers to, inside the same library."""
    at = [c for c in ("owner_id", "seq") if c in rows.columns and c in locations.columns]
    places = locations.select(*at, F.col("LocationId").alias(column), location_identity().alias(to))
    return rows.join(places, [*at, column], "left")


def bookmark_names(rows: DataFrame, places: DataFrame) -> DataFrame:
    both = with_place(with_place(rows, places, "PublicationLocationId", "_pub"), places, "LocationId", "_loc")
    return named(both, "Bookmark", key("_pub", "_loc", "BlockType", "BlockIdentifier"), F.col("Title"))


def missing_bookmarks(sources: DataFrame, source_locations: DataFrame, merged: DataFrame, merged_locations: DataFrame) -> DataFrame:
    return not_found(bookmark_names(sources, source_locations), bookmark_names(merged, merged_locations))


def answer_names(rows: DataFrame, places: DataFrame) -> DataFrame:
    return named(with_place(rows, places, "LocationId", "_loc"), "InputField", key("_loc", "TextTag"), F.col("TextTag"))


def missing_answers(sources: DataFrame, source_locations: DataFrame, merged: DataFrame, merged_locations: DataFrame) -> DataFrame:
    return not_found(answer_names(sources, source_locations), answer_names(merged, merged_locations))


#: Tables that the content key of a playlist item is made of.
ITEM_PARTS = ("PlaylistItem", "TagMap", "Tag", "IndependentMedia", "PlaylistItemIndependentMediaMap", "PlaylistItemLocationMap", "Location")


def item_names(tables: dict[str, DataFrame]) -> DataFrame:
    """Playlist items by content key; tables without seq are one snapshot."""
    t = [tables[n] if "seq" in tables[n].columns else tables[n].withColumn("seq", F.lit(0)) for n in ITEM_PARTS]
    return named(item_keys(*t), "PlaylistItem", F.col("item_key"), F.col("Label"))


def missing_items(sources: dict[str, DataFrame], merged: dict[str, DataFrame]) -> DataFrame:
    return not_found(item_names(sources), item_names(merged))


def all_names(tables: dict[str, DataFrame]) -> DataFrame:
    """Everything of a library that must be found again, by table."""
    places = tables["Location"]
    parts = [simple_names(n, tables[n]) for n in SIMPLE]
    parts += [location_names(places), bookmark_names(tables["Bookmark"], places), answer_names(tables["InputField"], places), item_names(tables)]
    return reduce(DataFrame.unionByName, parts)


def missing_files(media: DataFrame, members: DataFrame) -> DataFrame:
    """Media rows whose file is not among the members of their archive."""
    at = [c for c in ("owner_id", "seq") if c in media.columns and c in members.columns]
    return media.join(members.select(*at, F.col("member").alias("FilePath")), [*at, "FilePath"], "left_anti")


def checked(tables: dict[str, DataFrame]) -> DataFrame:
    """owner_id, table, checked: rows looked up for each table."""
    return reduce(DataFrame.unionByName, (df.groupBy("owner_id").agg(F.count("*").alias("checked")).select("owner_id", F.lit(t).alias("table"), "checked") for t, df in tables.items()))


def verdicts(owners: DataFrame, missing: DataFrame) -> DataFrame:
    """owner_id, missing (number) and ok for each owner."""
    n = missing.groupBy("owner_id").agg(F.count("*").alias("missing"))
    return owners.select("owner_id").distinct().join(n, "owner_id", "left").select("owner_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.col("missing").isNull().alias("ok"))


def first_missing(missing: DataFrame, limit: int = 50) -> DataFrame:
    """The first rows of each owner's list, for a report."""
    w = W.partitionBy("owner_id").orderBy("seq", "table", "identity")
    return missing.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def explained(missing: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Adds explained: the merge reported a conflict of that table for that snapshot."""
    known = conflicts.select("owner_id", "seq", "table").distinct().withColumn("explained", F.lit(True))
    return missing.join(known, ["owner_id", "seq", "table"], "left").withColumn("explained", F.coalesce("explained", F.lit(False)))


def broken_references(tables: dict[str, DataFrame], references=REFERENCES, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """owner_id, table, column, parent, value and rows (how many) of references to nothing; null references pass.

    All references and all that they may refer to are dealt by (owner, parent, value) once, and counted there. parents:
    where to look targets up, if not in `tables`.
    """
    parents = tables if parents is None else parents
    known = [(k, *r) for k, r in enumerate(references) if r[0] in tables and r[2] in parents]
    targets = sorted({(p, t) for _, _, _, p, t in known})
    value = lambda df, p, t, c, k: df.select("owner_id", F.lit(targets.index((p, t))).alias("target"), F.col(c).cast("string").alias("value"), F.lit(k).alias("k")).dropna()
    rows = [value(tables[child], parent, target, column, k) for k, child, column, parent, target in known]
    rows += [value(parents[p], p, t, t, -1) for p, t in targets]
    met = reduce(DataFrame.unionByName, rows).groupBy("owner_id", "target", "value").agg(F.max(F.col("k") == -1).alias("there"), *(F.count_if(F.col("k") == k).alias(f"n{k}") for k, *_ in known))
    each = F.array(*(F.struct(F.lit(child).alias("table"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), F.col(f"n{k}").alias("rows")) for k, child, column, parent, _ in known))
    return met.filter("not there").select("owner_id", "value", F.explode(F.filter(each, lambda x: x["rows"] > 0)).alias("x")).select("owner_id", "x.table", "x.column", "x.parent", "value", "x.rows")


#: Table: ((rule, SQL condition that holds unless false), ...); a null condition passes, as in SQL.
BLOCK = "(BlockType = 0 and BlockIdentifier is null) or (BlockType between 1 and 2 and BlockIdentifier is not null)"
CHECKS = {
    "BlockRange": (("block type", "BlockType between 1 and 2"),),
    "Bookmark": (("block", BLOCK),),
    "Note": (("block", BLOCK),),
    "IndependentMedia": (("filled", "length(OriginalFilename) > 0 and length(FilePath) > 0 and length(MimeType) > 0 and length(Hash) > 0"),),
    "PlaylistItem": (("label", "length(Label) > 0"), ("end action", "EndAction in (0, 1, 2, 3)")),
    "Tag": (("name", "length(Name) > 0"), ("type", "Type in (0, 1, 2)")),
    "TagMap": (("one reference", "(case when NoteId is null then 0 else 1 end) + (case when LocationId is null then 0 else 1 end) + (case when PlaylistItemId is null then 0 else 1 end) = 1"),),
    "Location": (
        ("document", "Type <> 0 or coalesce(DocumentId, 0) <> 0 or (Track is not null and length(coalesce(KeySymbol, '')) > 0) or (coalesce(BookNumber, 0) <> 0 and length(coalesce(KeySymbol, '')) > 0)"),
        ("bible", "Type <> 1 or (coalesce(BookNumber, 0) = 0 and coalesce(ChapterNumber, 0) = 0 and coalesce(DocumentId, 0) = 0 and length(coalesce(KeySymbol, '')) > 0 and Track is null)"),
        ("audio or video", "Type not in (2, 3) or (coalesce(BookNumber, 0) = 0 and coalesce(ChapterNumber, 0) = 0)"),
    ),
}

#: Table: columns that are never null.
REQUIRED = {
    "BlockRange": ("BlockType", "Identifier", "UserMarkId"),
    "Bookmark": ("LocationId", "PublicationLocationId", "Slot", "Title", "BlockType"),
    "IndependentMedia": ("OriginalFilename", "FilePath", "MimeType", "Hash"),
    "InputField": ("LocationId", "TextTag", "Value"),
    "LastModified": ("LastModified",),
    "Location": ("IssueTagNumber", "Type"),
    "Note": ("Guid", "LastModified", "Created", "BlockType"),
    "PlaylistItem": ("Label", "Accuracy", "EndAction"),
    "PlaylistItemAccuracy": ("Description",),
    "PlaylistItemIndependentMediaMap": ("PlaylistItemId", "IndependentMediaId", "DurationTicks"),
    "PlaylistItemLocationMap": ("PlaylistItemId", "LocationId", "MajorMultimediaType"),
    "PlaylistItemMarker": ("PlaylistItemId", "Label", "StartTimeTicks", "DurationTicks", "EndTransitionDurationTicks"),
    "PlaylistItemMarkerBibleVerseMap": ("PlaylistItemMarkerId", "VerseId"),
    "PlaylistItemMarkerParagraphMap": ("PlaylistItemMarkerId", "MepsDocumentId", "ParagraphIndex", "MarkerIndexWithinParagraph"),
    "Tag": ("Type", "Name"),
    "TagMap": ("TagId", "Position"),
    "UserMark": ("ColorIndex", "LocationId", "StyleIndex", "UserMarkGuid", "Version"),
    "grdb_migrations": ("identifier",),
}

#: Table: (columns of a unique key, ...); rows with a null in the key do not clash.
UNIQUES = {
    "Location": (("LocationId",), ("BookNumber", "ChapterNumber", "KeySymbol", "MepsLanguage", "Type"), ("KeySymbol", "IssueTagNumber", "MepsLanguage", "DocumentId", "Track", "Type", "coalesce(Specialty, '')", "coalesce(Edition, '')")),
    "UserMark": (("UserMarkId",), ("UserMarkGuid",)),
    "BlockRange": (("BlockRangeId",),),
    "Note": (("NoteId",), ("Guid",)),
    "Bookmark": (("BookmarkId",), ("PublicationLocationId", "Slot")),
    "InputField": (("LocationId", "TextTag"),),
    "Tag": (("TagId",), ("Type", "Name")),
    "TagMap": (("TagMapId",), ("TagId", "Position"), ("TagId", "NoteId"), ("TagId", "LocationId")),
    "IndependentMedia": (("IndependentMediaId",), ("FilePath",)),
    "PlaylistItem": (("PlaylistItemId",),),
    "PlaylistItemAccuracy": (("PlaylistItemAccuracyId",), ("Description",)),
    "PlaylistItemIndependentMediaMap": (("PlaylistItemId", "IndependentMediaId"),),
    "PlaylistItemLocationMap": (("PlaylistItemId", "LocationId"),),
    "PlaylistItemMarker": (("PlaylistItemMarkerId",), ("PlaylistItemId", "StartTimeTicks")),
    "PlaylistItemMarkerBibleVerseMap": (("PlaylistItemMarkerId", "VerseId"),),
    "PlaylistItemMarkerParagraphMap": (("PlaylistItemMarkerId", "MepsDocumentId", "ParagraphIndex", "MarkerIndexWithinParagraph"),),
    "grdb_migrations": (("identifier",),),
}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """owner_id, table, rule, rows: how many rows break each constraint.

    Checks and nulls are found where rows are read. Unique keys of all tables are dealt together by one digest of owner,
    key and values.
    """
    broken, keys = [], []
    for table, df in tables.items():
        rules = {f"check: {rule}": f"not ({condition})" for rule, condition in CHECKS.get(table, ())}
        rules |= {f"not null: {c}": f"{c} is null" for c in REQUIRED.get(table, ()) if c in df.columns}
        if rules:
            each = F.array_compact(F.array(*(F.when(F.expr(condition), F.lit(rule)) for rule, condition in rules.items())))
            broken.append(df.select("owner_id", F.lit(table).alias("table"), F.explode(each).alias("rule")).withColumn("rows", F.lit(1).cast("long")))
        for columns in UNIQUES.get(table, ()):
            filled = df.select("owner_id", *(F.expr(c).alias(f"k{i}") for i, c in enumerate(columns))).dropna(subset=[f"k{i}" for i in range(len(columns))])
            keys.append(filled.select("owner_id", F.lit(table).alias("table"), F.lit(f"unique: {', '.join(columns)}").alias("rule"), key(*(f"k{i}" for i in range(len(columns)))).alias("digest")))
    if keys:
        twice = reduce(DataFrame.unionByName, keys).groupBy("owner_id", "table", "rule", "digest").agg(F.count("*").alias("rows")).filter("rows > 1")
        broken.append(twice.drop("digest"))
    return reduce(DataFrame.unionByName, broken).groupBy("owner_id", "table", "rule").agg(F.sum("rows").alias("rows"))


def added_again(decisions: DataFrame) -> DataFrame:
    """Decisions that break idempotence when the sources of a merge are merged into its own result."""
    return decisions.filter("action in ('added', 'updated')")

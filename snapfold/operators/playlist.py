"""Playlist items by content, and the tables that hang on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.functions.keys import key, location_identity
from snapfold.operators import resolve
from snapfold.operators.merge import Merged, decisions_of
from snapfold.operators.resolve import AS_IS, Layout


def owning_tag(tag_maps: DataFrame, tags: DataFrame) -> DataFrame:
    """owner_id, seq, PlaylistItemId, tag_type, tag_name: the tag of the item's last tag map."""
    t = tags.select("owner_id", "seq", "TagId", "Type", "Name")
    joined = tag_maps.filter("PlaylistItemId is not null").join(t, ["owner_id", "seq", "TagId"])
    last = F.max_by(F.struct("Type", "Name"), "TagMapId")
    return joined.groupBy("owner_id", "seq", "PlaylistItemId").agg(last.alias("t")).select("owner_id", "seq", "PlaylistItemId", F.col("t.Type").alias("tag_type"), F.col("t.Name").alias("tag_name"))


def item_keys(items: DataFrame, tag_maps: DataFrame, tags: DataFrame, media: DataFrame, media_maps: DataFrame, location_maps: DataFrame, locations: DataFrame) -> DataFrame:
    """items with item_key: a digest of tag, label, trims, end action, thumbnail hash, and the sets of media and places.

    locations gives the identity of each place: `identity` if it has that column, else its ten identity columns.
    """
    at = ["owner_id", "seq"]
    hashes = media.select(*at, "IndependentMediaId", "Hash", "FilePath")
    m = media_maps.join(hashes.drop("FilePath"), [*at, "IndependentMediaId"]).groupBy(*at, "PlaylistItemId").agg(F.array_sort(F.collect_set(F.struct("Hash", "DurationTicks"))).alias("media_set"))
    places = locations if "identity" in locations.columns else locations.withColumn("identity", location_identity())
    p = location_maps.join(places.select(*at, "LocationId", "identity"), [*at, "LocationId"]).groupBy(*at, "PlaylistItemId").agg(F.array_sort(F.collect_set(F.struct("identity", "MajorMultimediaType", "BaseDurationTicks"))).alias("place_set"))
    thumbs = hashes.groupBy(*at, F.col("FilePath").alias("ThumbnailFilePath")).agg(F.min("Hash").alias("thumb"))
    out = items.join(owning_tag(tag_maps, tags), [*at, "PlaylistItemId"], "left").join(m, [*at, "PlaylistItemId"], "left").join(p, [*at, "PlaylistItemId"], "left").join(thumbs, [*at, "ThumbnailFilePath"], "left")
    none = F.array()
    k = key("tag_type", "tag_name", "Label", "StartTrimOffsetTicks", "EndTrimOffsetTicks", "EndAction", "thumb", F.coalesce(F.to_json("media_set"), F.to_json(none)), F.coalesce(F.to_json("place_set"), F.to_json(none)))
    return out.withColumn("item_key", k).select(*items.columns, "item_key")


def merge_items(keyed: DataFrame, accuracy_ids: DataFrame, paths: DataFrame, media: DataFrame, keep: Layout = AS_IS) -> Merged:
    """Items by content key; unknown accuracies stay, thumbnails follow their media or go."""
    marked = keep(resolve.first_wins(keyed, "item_key"))
    numbered = keep(resolve.with_new_ids(marked, "PlaylistItemId", keep))
    ids = resolve.id_map(marked, numbered, "PlaylistItemId")
    rows = resolve.remap(numbered, "Accuracy", accuracy_ids, "_acc", base=True).withColumn("_acc", F.coalesce("_acc", "Accuracy"))
    where = paths.groupBy("owner_id", "seq", F.col("src_path").alias("ThumbnailFilePath")).agg(F.min("path").alias("_path"))
    new = rows.join(where, ["owner_id", "seq", "ThumbnailFilePath"], "left").withColumn("_path", F.coalesce("_path", "ThumbnailFilePath"))
    there = media.select("owner_id", F.col("FilePath").alias("_path"), F.lit(True).alias("_there")).distinct()
    rows = new.join(there, ["owner_id", "_path"], "left").withColumn("_path", F.when(F.col("seq") == 0, F.col("ThumbnailFilePath")).when(F.col("_there"), F.col("_path"))).drop("_there")
    final = rows.select(F.col("target_id").alias("PlaylistItemId"), "owner_id", "Label", "StartTrimOffsetTicks", "EndTrimOffsetTicks", F.col("_acc").alias("Accuracy"), "EndAction", F.col("_path").alias("ThumbnailFilePath"))
    return Merged(final, decisions_of(marked, "PlaylistItem"), ids=ids)


def merge_links(rows: DataFrame, table: str, refs: dict[str, DataFrame], keys: tuple[str, ...], silent: bool = False) -> Merged:
    """Insert-or-ignore on a primary key after remapping `refs`; rows with an unknown side are skipped (silent: uncounted)."""
    names = [c for c in rows.columns if c not in ("seq", "row_ord")]
    lost = F.lit(False)
    for column, ids in refs.items():
        rows = resolve.remap(rows, column, ids, f"_{column}", base=True)
        lost = lost | F.col(f"_{column}").isNull()
    lost = (F.col("seq") > 0) & lost
    marked = resolve.first_wins(rows.filter(~lost), *(f"_{k}" if k in refs else k for k in keys))
    final = marked.filter("action in ('base', 'added')").select(*(F.col(f"_{c}").alias(c) if c in refs else F.col(c) for c in names))
    done = decisions_of(marked, table)
    return Merged(final, done if silent else done.union(decisions_of(rows.filter(lost).withColumn("action", F.lit("skipped")), table)))


def merge_media_maps(rows: DataFrame, item_ids: DataFrame, media_ids: DataFrame) -> Merged:
    return merge_links(rows, "PlaylistItemIndependentMediaMap", {"PlaylistItemId": item_ids, "IndependentMediaId": media_ids}, ("PlaylistItemId", "IndependentMediaId"))


def merge_location_maps(rows: DataFrame, item_ids: DataFrame, location_ids: DataFrame) -> Merged:
    return merge_links(rows, "PlaylistItemLocationMap", {"PlaylistItemId": item_ids, "LocationId": location_ids}, ("PlaylistItemId", "LocationId"))


def merge_markers(rows: DataFrame, item_ids: DataFrame, keep: Layout = AS_IS) -> Merged:
    rows = resolve.remap(rows, "PlaylistItemId", item_ids, "_item", base=True)
    marked = keep(resolve.first_wins(rows.filter("seq = 0 or _item is not null"), "_item", "StartTimeTicks"))
    numbered = keep(resolve.with_new_ids(marked, "PlaylistItemMarkerId", keep))
    final = numbered.select(F.col("target_id").alias("PlaylistItemMarkerId"), "owner_id", F.col("_item").alias("PlaylistItemId"), "Label", "StartTimeTicks", "DurationTicks", "EndTransitionDurationTicks")
    lost = decisions_of(rows.filter("seq > 0 and _item is null").withColumn("action", F.lit("skipped")), "PlaylistItemMarker")
    return Merged(final, decisions_of(marked, "PlaylistItemMarker").union(lost), ids=resolve.id_map(marked, numbered, "PlaylistItemMarkerId"))


def merge_verse_maps(rows: DataFrame, marker_ids: DataFrame) -> Merged:
    return merge_links(rows, "PlaylistItemMarkerBibleVerseMap", {"PlaylistItemMarkerId": marker_ids}, ("PlaylistItemMarkerId", "VerseId"), silent=True)


def merge_paragraph_maps(rows: DataFrame, marker_ids: DataFrame) -> Merged:
    return merge_links(rows, "PlaylistItemMarkerParagraphMap", {"PlaylistItemMarkerId": marker_ids}, ("PlaylistItemMarkerId", "MepsDocumentId", "ParagraphIndex", "MarkerIndexWithinParagraph"), silent=True)

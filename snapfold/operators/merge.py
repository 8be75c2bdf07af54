"""Merge of all snapshots of all owners, one function for each table.

Inputs are tables with owner_id, seq (0: the base) and row_ord. Every function returns a Merged: the final rows, a row for
each input row with what was done (decisions), conflicts, and the map from source to target ids where the table has ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.functions.keys import key, location_identity, media_key, renamed_path, unique_key
from snapfold.operators import resolve
from snapfold.operators.resolve import AS_IS, Layout
from snapfold.schema import LOCATION_IDENTITY
from snapfold.shared import cut

CONFLICT = ("owner_id", "seq", "table", "detail", "resolution")


class Merged:
    """rows and ids need numbered rows, which are written once; given as functions, they are worked out when first asked for,
    so that decisions alone don't cost that."""

    def __init__(self, rows: DataFrame | Callable[[], DataFrame], decisions: DataFrame, conflicts: DataFrame | None = None, ids: DataFrame | Callable[[], DataFrame] | None = None, marked: DataFrame | None = None):
        self._rows, self.decisions, self.conflicts, self._ids, self.marked = rows, decisions, conflicts, ids, marked

    @cached_property
    def rows(self) -> DataFrame:
        return self._rows() if callable(self._rows) else self._rows

    @cached_property
    def ids(self) -> DataFrame | None:
        return self._ids() if callable(self._ids) else self._ids


def decisions_of(rows: DataFrame, table: str) -> DataFrame:
    return rows.filter("action <> 'base'").select("owner_id", "seq", F.lit(table).alias("table"), "row_ord", "action")


def conflicts_of(rows: DataFrame, table: str, detail: Column, resolution: Column | str) -> DataFrame:
    what = F.lit(resolution) if isinstance(resolution, str) else resolution
    return rows.select("owner_id", "seq", F.lit(table).alias("table"), detail.alias("detail"), what.alias("resolution"))


def merge_migrations(rows: DataFrame) -> Merged:
    """Union of identifiers; nothing is counted."""
    return Merged(rows.select("owner_id", "identifier").distinct(), rows.limit(0).select("owner_id", "seq", F.lit("grdb_migrations").alias("table"), "row_ord", F.lit("").alias("action")))


def _by_key(rows: DataFrame, table: str, id_column: str, *keys: str, keep: Layout = AS_IS) -> Merged:
    marked = keep(resolve.first_wins(rows, *keys))
    numbered = cache(lambda: keep(resolve.with_new_ids(marked, id_column, keep)))
    names = [c for c in rows.columns if c not in ("seq", "row_ord", id_column)]
    final = lambda: numbered().select(F.col("target_id").alias(id_column), *names)
    return Merged(final, decisions_of(marked, table), ids=lambda: resolve.id_map(marked, numbered(), id_column))


def merge_accuracies(rows: DataFrame, keep: Layout = AS_IS) -> Merged:
    return _by_key(rows, "PlaylistItemAccuracy", "PlaylistItemAccuracyId", "Description", keep=keep)


def merge_tags(rows: DataFrame, keep: Layout = AS_IS) -> Merged:
    return _by_key(rows, "Tag", "TagId", "Type", "Name", keep=keep)


def first_come(part: pd.DataFrame) -> pd.DataFrame:
    """Places that share keys, one after the other: a place stands for itself unless its identity, book key or media key is
    taken; only places that stand for themselves take keys, and among base places the last takes an identity."""
    found: dict[tuple, tuple] = {}
    out = []
    for r in part.sort_values(["seq", "row_ord"]).itertuples(index=False):
        here = (r.seq, r.row_ord)
        names = [n for n in (("id", r.identity), ("k1", r.k1), ("k2", r.k2)) if isinstance(n[1], str)]
        hit = None if r.seq == 0 else next((n for n in names if n in found), None)
        if hit is None:
            for n in names:
                found.setdefault(n, here)
            if r.seq == 0:
                found[names[0]] = here
            out.append((r.owner_id, *here, "base" if r.seq == 0 else "added", *here, False))
        else:
            out.append((r.owner_id, *here, "reused", *found[hit], hit[0] != "id"))
    return pd.DataFrame(out, columns=["owner_id", "_s", "_r", "found", "lead_seq", "lead_ord", "off"])


def connected_keys(places: DataFrame, layout: Layout = AS_IS) -> DataFrame:
    """owner_id, identity and label of distinct (owner_id, identity, k1, k2): equal labels where keys connect them.

    Every round takes the least label among those that share a key, and then that label's own label, so chains shrink by half.
    """
    hold = layout if layout is not AS_IS else Layout(cut)
    now = hold(places.distinct().withColumn("label", F.col("identity")))
    while True:
        least = now
        for k in ("k1", "k2"):
            among = F.min("label").over(W.partitionBy("owner_id", F.coalesce(k, "identity")))
            least = least.withColumn("label", F.when(F.col(k).isNull(), F.col("label")).otherwise(among))
        least = least.withColumnRenamed("label", "_own")
        jump = least.select("owner_id", F.col("identity").alias("_own"), F.col("_own").alias("label"))
        new = hold(least.join(jump, ["owner_id", "_own"]).select("owner_id", "identity", "k1", "k2", "label"))
        moved = new.select("owner_id", "identity", F.col("label").alias("_new")).join(now, ["owner_id", "identity"]).filter("_new <> label")
        now = new
        if moved.isEmpty():
            return now.select("owner_id", "identity", "label")


def location_actions(rows: DataFrame, layout: Layout = AS_IS) -> DataFrame:
    """Adds action, lead and clash to places.

    A place's group is its book key, else its media key, else its whole identity, and the first row of a group stands for
    all. Only places that share a key with one that has both are resolved row by row, in a task for each set of places that
    such keys connect.
    """
    keyed = rows.withColumn("_id", location_identity()).withColumn("_k1", unique_key()).withColumn("_k2", media_key())
    both = (F.col("_k1").isNotNull() & F.col("_k2").isNotNull()).cast("int")
    # rows without a key are spread by their identity
    near = lambda k: F.col(k).isNotNull() & (F.max(both).over(W.partitionBy("owner_id", F.coalesce(k, "_id"))) == 1)
    keyed = layout(keyed.withColumn("_near", near("_k1") | near("_k2")))
    g = F.coalesce(F.concat(F.lit("1"), "_k1"), F.concat(F.lit("2"), "_k2"), F.concat(F.lit("3"), "_id"))
    w = W.partitionBy("owner_id", g)
    # among base rows without keys the last one stands for the group
    rank = F.row_number().over(w.orderBy(F.when(F.col("seq") == 0, 0).otherwise(1), F.when((F.col("seq") == 0) & F.col("_k1").isNull() & F.col("_k2").isNull(), -F.col("row_ord")), "seq", "row_ord"))
    out = keyed.withColumn("_rank", rank)
    lead, identity = F.max(F.when(F.col("_rank") == 1, F.struct("seq", "row_ord"))).over(w), F.max(F.when(F.col("_rank") == 1, F.col("_id"))).over(w)
    out = out.withColumn("lead", lead).withColumn("clash", (F.col("_id") != identity) & (F.col("seq") > 0))
    out = out.withColumn("action", F.when(F.col("seq") == 0, "base").when(F.col("_rank") == 1, "added").otherwise("reused"))
    slow = keyed.filter("_near").select("owner_id", "seq", "row_ord", F.col("_id").alias("identity"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"))
    if slow.isEmpty():
        return out.select(*rows.columns, "action", "lead", "clash")
    labelled = slow.join(connected_keys(slow.select("owner_id", "identity", "k1", "k2"), layout), ["owner_id", "identity"])
    kinds = dict(rows.dtypes)
    done = labelled.groupBy("owner_id", "label").applyInPandas(first_come, f"owner_id {kinds['owner_id']}, _s {kinds['seq']}, _r {kinds['row_ord']}, found string, lead_seq {kinds['seq']}, lead_ord {kinds['row_ord']}, off boolean")
    out = out.join(done.withColumnRenamed("owner_id", "_o"), (F.col("owner_id") == F.col("_o")) & (F.col("seq") == F.col("_s")) & (F.col("row_ord") == F.col("_r")), "left")
    stands = F.struct(F.col("lead_seq").alias("seq"), F.col("lead_ord").alias("row_ord"))
    given = F.col("found").isNotNull()
    return out.select(*rows.columns, F.coalesce("found", "action").alias("action"), F.when(given, stands).otherwise(F.col("lead")).alias("lead"), F.when(given, F.col("off")).otherwise(F.col("clash")).alias("clash"))


def merge_locations(rows: DataFrame, keep: Layout = AS_IS) -> Merged:
    marked = keep(location_actions(rows, keep))
    numbered = cache(lambda: keep(resolve.with_new_ids(marked, "LocationId", keep)))
    final = lambda: numbered().select(F.col("target_id").alias("LocationId"), "owner_id", *LOCATION_IDENTITY, "Title")
    clash = conflicts_of(marked.filter("clash"), "Location", F.format_string("place %s", F.col("LocationId")), "mapped to the place that holds its key")
    return Merged(final, decisions_of(marked, "Location"), clash, lambda: resolve.id_map(marked, numbered(), "LocationId"), marked)


def merge_media(rows: DataFrame, members: DataFrame, keep: Layout = AS_IS) -> tuple[Merged, DataFrame, DataFrame]:
    """Merged media, the map of paths (owner_id, seq, src_path, path) and the media plan (owner_id, member, seq, from_member).

    members: owner_id, seq, member of each archive.
    """
    marked = keep(resolve.first_wins(rows, "Hash"))
    # base rows keep their paths; of new ones with a path in common the first has it, where the base does not
    added = F.col("action") == "added"
    kept = marked.filter("action <> 'reused'").withColumn("_nth", F.row_number().over(resolve.window("FilePath", added)))
    taken = {"_row": rows.select("owner_id", "seq", "FilePath"), "_file": members.select("owner_id", "seq", F.col("member").alias("FilePath"))}
    for name, df in taken.items():
        kept = kept.join(df.filter("seq = 0").drop("seq").distinct().withColumn(name, F.lit(True)), ["owner_id", "FilePath"], "left")
    kept = kept.withColumn("renamed", added & (F.coalesce("_row", "_file", F.lit(False)) | (F.col("_nth") > 1)))
    kept = kept.withColumn("path", F.when(F.col("renamed"), renamed_path(F.col("owner_id").cast("string"), "Hash", "FilePath")).otherwise(F.col("FilePath"))).drop("_row", "_file", "_nth")
    there = members.select("owner_id", "seq", F.col("member").alias("FilePath"), F.lit(True).alias("_present")).distinct()
    kept = kept.join(there, ["owner_id", "seq", "FilePath"], "left").withColumn("present", ~added | F.coalesce("_present", F.lit(False))).drop("_present")
    numbered = keep(resolve.with_new_ids(kept, "IndependentMediaId", keep))
    new = numbered.filter("action = 'added'")
    final = numbered.select(F.col("target_id").alias("IndependentMediaId"), "owner_id", "OriginalFilename", F.col("path").alias("FilePath"), "MimeType", "Hash")
    gone = conflicts_of(new.filter("not present"), "IndependentMedia", F.concat(F.col("FilePath"), F.lit(" is not in the archive")), "row kept, file missing")
    lead = numbered.select("owner_id", F.struct("seq", "row_ord").alias("lead"), "path")
    own = marked.withColumn("lead", F.when(F.col("action") == "base", F.struct("seq", "row_ord")).otherwise(F.col("lead")))
    paths = own.join(lead, ["owner_id", "lead"]).select("owner_id", "seq", F.col("FilePath").alias("src_path"), "path")
    plan = members.filter("seq = 0").select("owner_id", "member", "seq", F.col("member").alias("from_member")).union(new.filter("present").select("owner_id", F.col("path"), "seq", "FilePath"))
    done = decisions_of(marked, "IndependentMedia").union(new.filter("not present").select("owner_id", "seq", F.lit("IndependentMediaFile"), "row_ord", F.lit("skipped")))
    out = Merged(final, done, gone, resolve.id_map(marked, numbered, "IndependentMediaId"))
    out.renames = new.filter("renamed").select("owner_id", "seq", F.col("FilePath").alias("from_path"), "path")
    return out, paths, plan


def merge_marks(marks: DataFrame, ranges: DataFrame, location_ids: DataFrame, keep: Layout = AS_IS) -> tuple[Merged, Merged]:
    """Highlights by guid, the strictly higher version winning, and their ranges: an update replaces all of them, otherwise
    ranges unite by extent. Highlights on unknown places are skipped before anything else."""
    placed = resolve.remap(marks, "LocationId", location_ids, "_loc", base=True)
    skipped = placed.filter("_loc is null").withColumn("action", F.lit("skipped"))
    # only ids of the base count for numbers
    placed = placed.withColumn("_base_id", F.when(F.col("seq") == 0, F.col("UserMarkId")))
    known = resolve.highest_version(placed.filter("_loc is not null"), "Version", "UserMarkGuid")
    w = resolve.window("UserMarkGuid")
    last = F.max("epoch").over(W.partitionBy("owner_id", "UserMarkGuid"))
    known = keep(known.withColumns({"lead": F.first(F.struct("seq", "row_ord")).over(w), "_lead_id": F.first("_base_id").over(w), "last": last}))
    # what a guid comes to, in the place and with the id of its first row: numbered as it is, without a join
    base = F.when(F.col("lead.seq") == 0, "base").otherwise("added")
    one = known.filter("final").select("owner_id", "lead.seq", "lead.row_ord", F.col("_lead_id").alias("UserMarkId"), "ColorIndex", "_loc", "StyleIndex", "UserMarkGuid", "Version", base.alias("action"))
    numbered = cache(lambda: keep(resolve.with_new_ids(one, "UserMarkId", keep)))
    rows = lambda: numbered().select(F.col("target_id").alias("UserMarkId"), "owner_id", "ColorIndex", F.col("_loc").alias("LocationId"), "StyleIndex", "UserMarkGuid", "Version")
    each = known.withColumn("action", F.when(F.col("seq") == 0, "base").otherwise(F.col("action")))
    out = Merged(rows, decisions_of(known, "UserMark").union(decisions_of(skipped, "UserMark")), ids=lambda: resolve.id_map(each, numbered(), "UserMarkId"))

    r = ranges.join(known.select("owner_id", "seq", "UserMarkId", "UserMarkGuid", "epoch", "last"), ["owner_id", "seq", "UserMarkId"])
    extent = ("BlockType", "Identifier", "StartToken", "EndToken")
    r = r.withColumn("_n", F.row_number().over(resolve.window("UserMarkGuid", "epoch", *extent)))
    r = keep(r.withColumn("action", F.when(F.col("seq") == 0, "base").when(F.col("_n") == 1, "added").otherwise("reused")))

    def ranges_left() -> DataFrame:
        guid_ids = numbered().select("owner_id", "UserMarkGuid", F.col("target_id").alias("_mark"))
        kept = keep(r.filter("epoch = last and action <> 'reused'").select("owner_id", "seq", "row_ord", "BlockRangeId", *extent, "UserMarkGuid", "action").join(guid_ids, ["owner_id", "UserMarkGuid"]).drop("UserMarkGuid"))
        numbers = resolve.with_new_ids(kept, "BlockRangeId", keep)
        return numbers.select(F.col("target_id").alias("BlockRangeId"), "owner_id", *extent, F.col("_mark").alias("UserMarkId"))

    return out, Merged(ranges_left, decisions_of(r, "BlockRange"))


def merge_notes(notes: DataFrame, mark_ids: DataFrame, location_ids: DataFrame, keep: Layout = AS_IS) -> Merged:
    """Notes by guid: a later stamp wins if the text differs, all but Created being replaced."""
    text = F.unhex(key(F.coalesce("Title", F.lit("")), F.coalesce("Content", F.lit(""))))
    folded = keep(resolve.fold_newest(notes, "LastModified", text, "Guid", ident="NoteId", created="Created"))
    first = F.col("decisions")[0]
    marked = folded.select("owner_id", "Guid", F.struct(first["seq"].alias("seq"), first["row_ord"].alias("row_ord")).alias("lead"), F.explode("decisions").alias("d")).select("owner_id", "Guid", "lead", "d.*").withColumnRenamed("id", "NoteId")
    one = folded.select("owner_id", "Guid", first["seq"].alias("seq"), first["row_ord"].alias("row_ord"), first["id"].alias("NoteId"), first["action"].alias("action"), F.col("created").alias("Created"))
    numbered = cache(lambda: keep(resolve.with_new_ids(one, "NoteId", keep)))

    def final() -> DataFrame:
        won = folded.select("owner_id", "Guid", "seq", "row_ord").join(notes.drop("NoteId", "Created"), ["owner_id", "Guid", "seq", "row_ord"])
        won = resolve.remap(won, "UserMarkId", mark_ids, "_mark", zero_is_null=True, base=True)
        won = resolve.remap(won, "LocationId", location_ids, "_loc", zero_is_null=True, base=True)
        won = won.join(numbered().select("owner_id", "Guid", "target_id", "Created"), ["owner_id", "Guid"])
        return won.select(F.col("target_id").alias("NoteId"), "owner_id", "Guid", F.col("_mark").alias("UserMarkId"), F.col("_loc").alias("LocationId"), "Title", "Content", "LastModified", "Created", "BlockType", "BlockIdentifier")

    fights = marked.filter("action = 'updated' or tie")
    what = F.when(F.col("action") == "updated", "took the newer copy").otherwise("kept the copy already there")
    clash = conflicts_of(fights, "Note", F.concat(F.lit("note "), "Guid", F.lit(" differs at "), "stamp"), what)
    return Merged(final, decisions_of(marked, "Note"), clash, lambda: resolve.id_map(marked, numbered(), "NoteId"), marked)


def merge_bookmarks(bookmarks: DataFrame, location_ids: DataFrame, keep: Layout = AS_IS) -> Merged:
    rows = resolve.remap(bookmarks, "LocationId", location_ids, "_loc", base=True)
    rows = keep(resolve.remap(rows, "PublicationLocationId", location_ids, "_pub", base=True))
    lost = rows.filter("_loc is null or _pub is null").withColumn("action", F.lit("skipped"))
    marked = keep(resolve.first_free_slot(rows.filter("_loc is not null and _pub is not null"), "_pub", "Slot", "_loc", "BlockType", "BlockIdentifier"))

    def final() -> DataFrame:
        numbered = resolve.with_new_ids(marked, "BookmarkId", keep)
        return numbered.select(F.col("target_id").alias("BookmarkId"), "owner_id", F.col("_loc").alias("LocationId"), F.col("_pub").alias("PublicationLocationId"), F.col("final_slot").alias("Slot"), "Title", "Snippet", "BlockType", "BlockIdentifier")

    full = conflicts_of(marked.filter("action = 'skipped'"), "Bookmark", F.format_string("no free slot for %s", F.col("Title")), "left out")
    return Merged(final, decisions_of(marked, "Bookmark").union(decisions_of(lost, "Bookmark")), full)


def merge_answers(fields: DataFrame, location_ids: DataFrame, overwrite: bool = False) -> Merged:
    rows = resolve.remap(fields, "LocationId", location_ids, "_loc", base=True)
    lost = rows.filter("_loc is null").withColumn("action", F.lit("skipped"))
    known = rows.filter("_loc is not null")
    w = resolve.window("_loc", "TextTag")
    if overwrite:
        marked = resolve.last_wins(known, "Value", "_loc", "TextTag")
        final, differs, what = marked.filter("final"), F.col("action") == "updated", "took the source's answer"
    else:
        marked = resolve.first_wins(known, "_loc", "TextTag").withColumn("_kept", F.first("Value").over(w))
        first = (F.col("lead.seq") == F.col("seq")) & (F.col("lead.row_ord") == F.col("row_ord"))
        final, differs, what = marked.filter(first), (F.col("action") == "reused") & ~F.col("Value").eqNullSafe(F.col("_kept")), "kept the first answer"
    clash = conflicts_of(marked.filter(differs), "InputField", F.concat(F.lit("answer "), "TextTag", F.lit(" differs")), what)
    return Merged(final.select("owner_id", F.col("_loc").alias("LocationId"), "TextTag", "Value"), decisions_of(marked, "InputField").union(decisions_of(lost, "InputField")), clash)


def merge_tag_maps(maps: DataFrame, tag_ids: DataFrame, item_ids: DataFrame, location_ids: DataFrame, note_ids: DataFrame, keep: Layout = AS_IS) -> Merged:
    """New ones go behind the last position of their tag, in order of source, its tag id and its position."""
    refs = (("PlaylistItemId", item_ids, "_item"), ("LocationId", location_ids, "_loc"), ("NoteId", note_ids, "_note"))
    rows = resolve.remap(maps, "TagId", tag_ids, "_tag", base=True)
    lost = F.col("_tag").isNull()
    for column, ids, to in refs:
        rows = resolve.remap(rows, column, ids, to, zero_is_null=True, base=True)
        lost = lost | (F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(0)) != 0) & F.col(to).isNull()
    lost = (F.col("seq") > 0) & lost
    rows = keep(rows)
    gone, rows = rows.filter(lost).withColumn("action", F.lit("skipped")), rows.filter(~lost)
    marked = keep(resolve.append_position(rows, "_tag", "Position", ("TagId", "Position", "row_ord"), "_item", "_loc", "_note", layout=keep))

    def final() -> DataFrame:
        numbered = resolve.with_new_ids(marked, "TagMapId", keep)
        return numbered.select(F.col("target_id").alias("TagMapId"), "owner_id", F.col("_item").alias("PlaylistItemId"), F.col("_loc").alias("LocationId"), F.col("_note").alias("NoteId"), F.col("_tag").alias("TagId"), F.col("final_position").alias("Position"))

    return Merged(final, decisions_of(marked, "TagMap").union(decisions_of(gone, "TagMap")))


def stamp_modified(owners: DataFrame, now: str) -> DataFrame:
    """The single LastModified row of each owner; `now` is a parameter, so that reruns agree."""
    return owners.select("owner_id", F.lit(now).alias("LastModified")).distinct()

"""Registered queries: each operator over the projections of plans.projections, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.functions import keys
from snapfold.operators import incremental, merge, ordering, playlist, report, resolve, verify
from snapfold.operators.resolve import Layout
from snapfold.plans import jobs
from snapfold.plans.projections import Views, with_views
from snapfold.schema import LOCATION_IDENTITY, TABLES
from snapfold.shared import cut
from snapfold.shipping import ship
from snapfold.sources import archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Views under a name, with its oracle."""

    def put(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(ship(spark), sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return put


def outcome(merged: merge.Merged) -> DataFrame:
    """owner_id, seq, row_ord, action, target_id of every row, for tables whose row_ord is their id."""
    d = merged.decisions.select("owner_id", "seq", "row_ord", "action")
    return merged.ids.withColumnRenamed("src_id", "row_ord").join(d, ["owner_id", "seq", "row_ord"], "left").select("owner_id", "seq", "row_ord", F.coalesce("action", F.lit("base")).alias("action"), "target_id")


def outcome_sql(source: str, key: str, ident: str) -> str:
    return f"""with f as (select *, row_number() over (partition by owner_id, {key} order by seq, row_ord) as n from {source}),
    g as (select *, case when seq = 0 then 'base' when n = 1 then 'added' else 'reused' end as action, max(case when seq = 0 then {ident} end) over (partition by owner_id) as top from f),
    h as (select *, case when action = 'base' then {ident} when action = 'added' then coalesce(top, 0) + sum(case when action = 'added' then 1 else 0 end) over (partition by owner_id order by seq, row_ord) end as own from g)
    select owner_id, seq, row_ord, action, cast(case when action = 'base' then own else first_value(own) over (partition by owner_id, {key} order by seq, row_ord) end as bigint) as target_id from h"""


IDENT = ", ".join(LOCATION_IDENTITY)
MAPPED = """with r as (select b.*, case when b.seq = 0 then b.{c} else m.target_id end as {to} from {view} b
    left join id_map m on m.owner_id = b.owner_id and m.seq = b.seq and m.src_id = b.{c})"""


# ---- projections, keys, gates

@query("p1_location_identity", f"select owner_id, count(*) as places from (select distinct owner_id, {IDENT} from loc) x group by owner_id")
def _(v):
    return v.loc.select("owner_id", keys.location_identity().alias("i")).distinct().groupBy("owner_id").agg(F.count("*").alias("places"))


@query("p2_unique_key", "select owner_id, sum(case when BookNumber is null or ChapterNumber is null then 1 else 0 end) as without, count(distinct case when BookNumber is not null and ChapterNumber is not null then KeySymbol || '/' || BookNumber || '/' || ChapterNumber end) as keys from loc group by owner_id")
def _(v):
    return v.loc.withColumn("k", keys.unique_key()).groupBy("owner_id").agg(F.count_if(F.col("k").isNull()).alias("without"), F.countDistinct("k").alias("keys"))


@query("p3_media_key", "select owner_id, count(distinct case when DocumentId is not null and Track is not null then KeySymbol || '/' || DocumentId || '/' || Track || '/' || coalesce(Specialty, '') end) as keys from loc group by owner_id")
def _(v):
    return v.loc.withColumn("k", keys.media_key()).groupBy("owner_id").agg(F.countDistinct("k").alias("keys"))


STAMP = "coalesce(nullif(last_modified, ''), creation_date)"


@query("p4_snapshot_order", f"select owner_id, snapshot_id, cast(row_number() over (partition by owner_id order by {STAMP} desc, input_ord) - 1 as integer) as seq from snap")
def _(v):
    return ordering.with_seq(v.snap).select("owner_id", "snapshot_id", "seq")


@query("p5_accumulate_order", f"""select owner_id, snapshot_id, cast(row_number() over (partition by owner_id order by is_stable desc, {STAMP} desc, input_ord) - 1 as integer) as seq, false as fresh from snap
    union all select owner_id, snapshot_id, cast(row_number() over (partition by owner_id order by {STAMP} desc, input_ord) - 1 as integer), true from snap where not is_stable""")
def _(v):
    out = [ordering.with_seq_accumulating(v.snap, f).select("owner_id", "snapshot_id", "seq", F.lit(f).alias("fresh")) for f in (False, True)]
    return out[0].union(out[1])


@query("p6_version_gate", f"""with o as (select *, first_value(schema_version) over (partition by owner_id order by {STAMP} desc, input_ord) as base_version from snap),
    b as (select distinct owner_id from o where schema_version <> base_version)
    select owner_id, snapshot_id, schema_version, cast(base_version as integer) as base_version, 'refused' as verdict from o where schema_version <> base_version
    union all select owner_id, snapshot_id, schema_version, cast(base_version as integer), 'accepted' from o where owner_id not in (select owner_id from b)""")
def _(v):
    good, bad = ordering.version_gate(ordering.with_seq(v.snap))
    cols = ["owner_id", "snapshot_id", "schema_version"]
    return bad.select(*cols, "base_version", F.lit("refused").alias("verdict")).union(good.select(*cols, F.col("schema_version").alias("base_version"), F.lit("accepted")))


@query("p7_version_warnings", "select owner_id, snapshot_id, schema_version from snap where schema_version not in (14, 15, 16)")
def _(v):
    return ordering.version_warnings(v.snap).select("owner_id", "snapshot_id", "schema_version")


@query("p8_enough_inputs", "select owner_id, snapshot_id from snap where owner_id in (select owner_id from snap group by owner_id having count(*) >= 8)")
def _(v):
    return ordering.enough_inputs(v.snap, 8).select("owner_id", "snapshot_id")


MEMBERS = "select page_id % 50 as owner_id, page_id as input_ord, case page_id % 9 when 0 then 'userData.db' when 1 then 'manifest.json' when 2 then 'userData.db-wal' else url end as member from pages"


@query("p9_media_members", f"select owner_id, count(*) as members from ({MEMBERS}) p where member not in ('userData.db', 'manifest.json', 'userData.db-wal', 'userData.db-shm', 'userData.db-journal') group by owner_id")
def _(v):
    return ordering.media_members(v.sql(MEMBERS)).groupBy("owner_id").agg(F.count("*").alias("members"))


READDED = "select user_id as owner_id, event_id as input_ord, event_type as name, cast(floor(value) as bigint) % 3 as size from events"


@query("p10_drop_readded", f"select owner_id, name, size, min(input_ord) as input_ord from ({READDED}) x group by owner_id, name, size")
def _(v):
    return ordering.drop_readded(v.sql(READDED)).select("owner_id", "name", "size", "input_ord")


# ---- merge

@query("m1_new_ids", """with f as (select *, row_number() over (partition by owner_id, Guid order by seq, row_ord) as n, max(case when seq = 0 then NoteId end) over (partition by owner_id) as top from note)
    select owner_id, Guid as guid, case when seq = 0 then NoteId else coalesce(top, 0) + sum(case when seq > 0 then 1 else 0 end) over (partition by owner_id order by seq, row_ord) end as target_id from f where n = 1""")
def _(v):
    marked = resolve.first_wins(v.note, "Guid")
    return resolve.with_new_ids(marked.filter("action in ('base', 'added')"), "NoteId").select("owner_id", F.col("Guid").alias("guid"), "target_id")


@query("m2_remap_references", """select n.owner_id, n.seq, n.row_ord, m.target_id as mark from note n left join id_map m on m.owner_id = n.owner_id and m.seq = n.seq and m.src_id = nullif(n.UserMarkId, 0)""")
def _(v):
    return resolve.remap(v.note, "UserMarkId", v.id_map, "mark", zero_is_null=True).select("owner_id", "seq", "row_ord", "mark")


@query("m3_migrations", "select distinct owner_id, identifier from mig")
def _(v):
    return merge.merge_migrations(v.mig).rows


@query("m4_accuracies", outcome_sql("acc", "Description", "PlaylistItemAccuracyId"))
def _(v):
    return outcome(merge.merge_accuracies(v.acc))


@query("m5_tags", outcome_sql("tag", "Type, Name", "TagId"))
def _(v):
    return outcome(merge.merge_tags(v.tag))


G = "case when BookNumber is not null and ChapterNumber is not null then '1' || BookNumber || '/' || ChapterNumber || KeySymbol when DocumentId is not null and Track is not null then '2' || DocumentId || '/' || Track || KeySymbol || coalesce(Specialty, '') else '3' || KeySymbol || coalesce(Specialty, '~') end"
LOC_ORDER = f"case when seq = 0 then 0 else 1 end, case when seq = 0 and left({G}, 1) = '3' then -row_ord end, seq, row_ord"


@query("m6_locations", f"""with x as (select *, {G} as g, coalesce(Specialty, '~') as sp from loc),
    f as (select *, row_number() over (partition by owner_id, g order by {LOC_ORDER}) as n, first_value(sp) over (partition by owner_id, g order by {LOC_ORDER}) as lead_sp from x),
    a as (select *, case when seq = 0 then 'base' when n = 1 then 'added' else 'reused' end as action, max(case when seq = 0 then LocationId end) over (partition by owner_id) as top from f),
    h as (select *, case when action = 'base' then LocationId when action = 'added' then coalesce(top, 0) + sum(case when action = 'added' then 1 else 0 end) over (partition by owner_id order by seq, row_ord) end as mine from a)
    select owner_id, seq, row_ord, action, cast(case when action = 'base' then mine else first_value(mine) over (partition by owner_id, g order by {LOC_ORDER}) end as bigint) as target_id, seq > 0 and sp <> lead_sp as clash from h""")
def _(v):
    done = merge.merge_locations(v.loc, Layout(cut))
    return outcome(done).join(done.marked.select("owner_id", "seq", "row_ord", "clash"), ["owner_id", "seq", "row_ord"])


@query("m7_media_by_hash", outcome_sql("media", "Hash", "IndependentMediaId"))
def _(v):
    return outcome(_media(v)[0])


def _ids(v) -> DataFrame:
    """Ids of parents, written as an earlier step would leave them, so that Spark knows how few they are."""
    return cut(v.id_map, "ids")


def _media(v):
    done, paths, plan = merge.merge_media(v.media, v.member)
    done.decisions = done.decisions.filter("table = 'IndependentMedia'")
    return done, paths, plan


NEW_MEDIA = """with f as (select *, row_number() over (partition by owner_id, Hash order by seq, row_ord) as n from media),
    a as (select *, row_number() over (partition by owner_id, FilePath order by seq, row_ord) as nth from f where n = 1 and seq > 0),
    t as (select owner_id, FilePath as p from media where seq = 0 union select owner_id, member from member where seq = 0),
    w as (select a.*, t.p is not null or nth > 1 as renamed, sha256(a.owner_id || chr(1) || a.Hash || chr(1) || a.FilePath) as h,
      exists (select 1 from member m where m.owner_id = a.owner_id and m.seq = a.seq and m.member = a.FilePath) as present from a left join t on t.owner_id = a.owner_id and t.p = a.FilePath),
    z as (select *, case when renamed then substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '.mp3' else FilePath end as path from w)"""


@query("m8_media_renames", f"{NEW_MEDIA} select owner_id, seq, FilePath as from_path, path from z where renamed")
def _(v):
    return _media(v)[0].renames


@query("m9_media_plan", f"{NEW_MEDIA} select owner_id, member, seq, member as from_member, 'copy' as what from member where seq = 0 union all select owner_id, path, seq, FilePath, case when present then 'copy' else 'missing' end from z")
def _(v):
    done, path, plan = _media(v)
    gone = done.conflicts.select("owner_id", F.regexp_replace("detail", " is not in the archive$", "").alias("src_path"), "seq")
    lost = gone.join(path, ["owner_id", "seq", "src_path"]).select("owner_id", "path", "seq", "src_path", F.lit("missing"))
    return plan.withColumn("what", F.lit("copy")).union(lost)


MARKS = MAPPED.format(view="mark", c="LocationId", to="place") + """,
    f as (select *, max(coalesce(Version, 0)) over (partition by owner_id, UserMarkGuid order by seq, row_ord rows between unbounded preceding and 1 preceding) as prev from r where place is not null),
    a as (select *, case when seq = 0 then 'base' when prev is null then 'added' when coalesce(Version, 0) > prev then 'updated' else 'reused' end as action from f),
    e as (select *, sum(case when action = 'updated' then 1 else 0 end) over (partition by owner_id, UserMarkGuid order by seq, row_ord) as epoch from a)"""


@query("m10_highlights", MARKS + " select owner_id, seq, row_ord, action from e where action <> 'base' union all select owner_id, seq, row_ord, 'skipped' from r where place is null")
def _(v):
    return merge.merge_marks(v.mark, v.rng, _ids(v))[0].decisions.select("owner_id", "seq", "row_ord", "action")


@query("m10_highlights_final", MARKS + """, z as (select *, max(epoch) over (partition by owner_id, UserMarkGuid) as last, row_number() over (partition by owner_id, UserMarkGuid, epoch order by seq, row_ord) as n from e)
    select owner_id, UserMarkGuid as guid, ColorIndex as color, place, StyleIndex as style, Version as version from z where epoch = last and n = 1""")
def _(v):
    return merge.merge_marks(v.mark, v.rng, _ids(v))[0].rows.select("owner_id", F.col("UserMarkGuid").alias("guid"), F.col("ColorIndex").alias("color"), F.col("LocationId").alias("place"), F.col("StyleIndex").alias("style"), F.col("Version").alias("version"))


RANGES = MARKS + """, g as (select b.owner_id, b.seq, b.row_ord, b.Identifier, b.StartToken, b.EndToken, e.UserMarkGuid as guid, e.epoch, max(e.epoch) over (partition by b.owner_id, e.UserMarkGuid) as seen from rng b join e on e.owner_id = b.owner_id and e.seq = b.seq and e.UserMarkId = b.UserMarkId),
    l as (select owner_id, UserMarkGuid as guid, max(epoch) as last from e group by owner_id, UserMarkGuid),
    q as (select g.*, l.last, row_number() over (partition by g.owner_id, g.guid, g.epoch, Identifier, StartToken, EndToken order by seq, row_ord) as n from g join l on l.owner_id = g.owner_id and l.guid = g.guid),
    y as (select *, case when seq = 0 then 'base' when n = 1 then 'added' else 'reused' end as action from q)"""


@query("m11_block_ranges", RANGES + " select owner_id, seq, row_ord, action from y where action <> 'base'")
def _(v):
    return merge.merge_marks(v.mark, v.rng, _ids(v))[1].decisions.select("owner_id", "seq", "row_ord", "action")


@query("m11_block_ranges_final", RANGES + " select owner_id, Identifier as ident, StartToken as start_token, EndToken as end_token, count(*) as n from y where epoch = last and action <> 'reused' group by owner_id, Identifier, StartToken, EndToken")
def _(v):
    rows = merge.merge_marks(v.mark, v.rng, _ids(v))[1].rows
    return rows.groupBy("owner_id", F.col("Identifier").alias("ident"), F.col("StartToken").alias("start_token"), F.col("EndToken").alias("end_token")).agg(F.count("*").alias("n"))


def note_fold_sql() -> str:
    """The fold unrolled: one step for each device, since a guid occurs at most once on each."""
    text = "coalesce(Title, '') || chr(1) || coalesce(Content, '')"
    steps = ["s0 as (select owner_id, Guid, 0 as at, coalesce(LastModified, '') as stamp, t, 'base' as action, false as tie, 0 as step from x where seq = 0)"]
    for i in (1, 2, 3):
        same, later = f"x.t = s{i - 1}.t", f"x.stamp > s{i - 1}.stamp"
        take = f"(s{i - 1}.Guid is null or (x.Guid is not null and not ({same}) and {later}))"
        steps.append(f"""s{i} as (select coalesce(x.owner_id, s{i - 1}.owner_id) as owner_id, coalesce(x.Guid, s{i - 1}.Guid) as Guid,
            case when {take} then {i} else s{i - 1}.at end as at, case when {take} then x.stamp else s{i - 1}.stamp end as stamp, case when {take} then x.t else s{i - 1}.t end as t,
            case when x.Guid is null then null when s{i - 1}.Guid is null then 'added' when {take} then 'updated' else 'reused' end as action,
            coalesce(s{i - 1}.Guid is not null and x.Guid is not null and not ({same}) and x.stamp = s{i - 1}.stamp, false) as tie, {i} as step
            from (select * from x where seq = {i}) x full join s{i - 1} on s{i - 1}.owner_id = x.owner_id and s{i - 1}.Guid = x.Guid)""")
    return f"with x as (select owner_id, seq, Guid, coalesce(LastModified, '') as stamp, LastModified, {text} as t from note), " + ", ".join(steps)


@query("m12_notes", note_fold_sql() + " select owner_id, Guid as guid, step as seq, action, tie from (select * from s1 union all select * from s2 union all select * from s3) u where action is not null")
def _(v):
    marked = merge.merge_notes(v.note, v.id_map, v.id_map).marked
    return marked.filter("action <> 'base'").select("owner_id", F.col("Guid").alias("guid"), "seq", "action", "tie")


@query("m12_notes_final", note_fold_sql() + """, c as (select owner_id, Guid, Created, row_number() over (partition by owner_id, Guid order by seq) as n from note)
    select s3.owner_id, s3.Guid as guid, n.Title as title, n.Content as content, n.LastModified as modified, c.Created as created, case when n.seq = 0 then n.LocationId else m.target_id end as place
    from s3 join note n on n.owner_id = s3.owner_id and n.Guid = s3.Guid and n.seq = s3.at join c on c.owner_id = s3.owner_id and c.Guid = s3.Guid and c.n = 1
    left join id_map m on m.owner_id = n.owner_id and m.seq = n.seq and m.src_id = nullif(n.LocationId, 0)""")
def _(v):
    rows = merge.merge_notes(v.note, v.id_map, v.id_map, Layout(cut)).rows
    return rows.select("owner_id", F.col("Guid").alias("guid"), F.col("Title").alias("title"), F.col("Content").alias("content"), F.col("LastModified").alias("modified"), F.col("Created").alias("created"), F.col("LocationId").alias("place"))


BOOKMARKS = """with r as (select b.*, case when b.seq = 0 then b.LocationId else m.target_id end as place, case when b.seq = 0 then b.PublicationLocationId else p.target_id end as pub from bkm b
    left join id_map m on m.owner_id = b.owner_id and m.seq = b.seq and m.src_id = b.LocationId left join id_map p on p.owner_id = b.owner_id and p.seq = b.seq and p.src_id = b.PublicationLocationId),
    f as (select *, row_number() over (partition by owner_id, pub, place order by seq, row_ord) as n, min(seq) over (partition by owner_id, pub, place) as first_seq from r where place is not null and pub is not null),
    s as (select *, row_number() over (partition by owner_id, pub order by seq, row_ord) as rk from f where n = 1 and seq > 0),
    free as (select u.owner_id, u.pub, k.slot, row_number() over (partition by u.owner_id, u.pub order by k.slot) as rk from (select distinct owner_id, pub from s) u, (select p_partkey as slot from part where p_partkey between 0 and 9) k
      where not exists (select 1 from f b where b.seq = 0 and b.owner_id = u.owner_id and b.pub = u.pub and b.Slot = k.slot)),
    g as (select s.owner_id, s.pub, s.place, free.slot from s left join free on free.owner_id = s.owner_id and free.pub = s.pub and free.rk = s.rk),
    a as (select f.owner_id, f.seq, f.row_ord, case when f.seq = 0 then 'base' when first_seq = 0 then 'reused' when g.slot is null then 'skipped' when n = 1 then 'added' else 'reused' end as action,
      case when f.seq = 0 then f.Slot when first_seq > 0 and n = 1 then g.slot end as slot, f.pub, f.place from f left join g on g.owner_id = f.owner_id and g.pub = f.pub and g.place = f.place)"""


@query("m13_bookmarks", BOOKMARKS + " select owner_id, seq, row_ord, action from a where action <> 'base' union all select owner_id, seq, row_ord, 'skipped' from r where place is null or pub is null")
def _(v):
    return merge.merge_bookmarks(v.bkm, v.id_map).decisions.select("owner_id", "seq", "row_ord", "action")


@query("m13_bookmarks_final", BOOKMARKS + " select owner_id, pub, place, cast(slot as bigint) as slot from a where action in ('base', 'added')")
def _(v):
    return merge.merge_bookmarks(v.bkm, v.id_map).rows.select("owner_id", F.col("PublicationLocationId").alias("pub"), F.col("LocationId").alias("place"), F.col("Slot").alias("slot"))


ANSWERS = MAPPED.format(view="ans", c="LocationId", to="place") + """, f as (select *, row_number() over w as n, lag(Value) over w as prev, first_value(Value) over w as head, count(*) over (partition by owner_id, place, TextTag) as total
    from r where place is not null window w as (partition by owner_id, place, TextTag order by seq, row_ord))"""


@query("m14_answers_keep", ANSWERS + " select owner_id, place, TextTag as tag, Value as value from f where n = 1")
def _(v):
    return merge.merge_answers(v.ans, v.id_map).rows.select("owner_id", F.col("LocationId").alias("place"), F.col("TextTag").alias("tag"), F.col("Value").alias("value"))


@query("m14_answers_overwrite", ANSWERS + """ select owner_id, seq, row_ord, case when n = 1 then 'added' when Value = prev then 'reused' else 'updated' end as action from f where seq > 0
    union all select owner_id, seq, row_ord, 'skipped' from r where place is null""")
def _(v):
    return merge.merge_answers(v.ans, v.id_map, overwrite=True).decisions.select("owner_id", "seq", "row_ord", "action")


@query("m15_owning_tag", "select i.owner_id, i.seq, i.PlaylistItemId as item, t.Type as tag_type, t.Name as tag_name from item_tag i join ptag t on t.owner_id = i.owner_id and t.seq = i.seq and t.TagId = i.TagId")
def _(v):
    return playlist.owning_tag(v.item_tag, v.ptag).select("owner_id", "seq", F.col("PlaylistItemId").alias("item"), "tag_type", "tag_name")


def _keyed(v):
    return playlist.item_keys(v.item, v.item_tag, v.ptag, v.pmedia, v.pmm, v.plm, v.ploc)


#: One media and one place at most for each item here, so the sets are plain columns.
ITEM_KEY = """with k as (select i.*, t.Name as tag_name, p.Hash as thumb, m.IndependentMediaId as med, m.DurationTicks as dur, l.LocationId as plc, l.MajorMultimediaType as kind
    from item i join ptag t on t.owner_id = i.owner_id and t.seq = i.seq and t.TagId = i.PlaylistItemId % 5
    left join pmedia p on p.owner_id = i.owner_id and p.seq = i.seq and p.FilePath = i.ThumbnailFilePath
    left join pmm m on m.owner_id = i.owner_id and m.seq = i.seq and m.PlaylistItemId = i.PlaylistItemId
    left join plm l on l.owner_id = i.owner_id and l.seq = i.seq and l.PlaylistItemId = i.PlaylistItemId)"""
ITEM_COLUMNS = "tag_name, Label, StartTrimOffsetTicks, EndAction, thumb, med, dur, plc, kind"


@query("m16_item_keys", f"{ITEM_KEY} select owner_id, count(*) as keys, max(n) as largest from (select owner_id, count(*) as n from k group by owner_id, {ITEM_COLUMNS}) x group by owner_id")
def _(v):
    n = _keyed(v).groupBy("owner_id", "item_key").agg(F.count("*").alias("n"))
    return n.groupBy("owner_id").agg(F.count("*").alias("keys"), F.max("n").alias("largest"))


@query("m17_playlist_items", outcome_sql("k", ITEM_COLUMNS, "PlaylistItemId").replace("with f as", ITEM_KEY + ", f as", 1))
def _(v):
    paths = v.pmedia.select("owner_id", "seq", F.col("FilePath").alias("src_path"), F.col("FilePath").alias("path"))
    return outcome(playlist.merge_items(_keyed(v), v.id_map, paths, v.pmedia.filter("seq = 0"), Layout(cut)))


def links_sql(view: str, a: str, b: str) -> str:
    return f"""with r as (select x.*, case when x.seq = 0 then x.{a} else p.target_id end as one, case when x.seq = 0 then x.{b} else q.target_id end as two from {view} x
    left join id_map p on p.owner_id = x.owner_id and p.seq = x.seq and p.src_id = x.{a} left join id_map q on q.owner_id = x.owner_id and q.seq = x.seq and q.src_id = x.{b}),
    f as (select *, row_number() over (partition by owner_id, one, two order by seq, row_ord) as n from r where one is not null and two is not null)
    select owner_id, seq, row_ord, case when n = 1 then 'added' else 'reused' end as action from f where seq > 0
    union all select owner_id, seq, row_ord, 'skipped' from r where one is null or two is null"""


@query("m18_item_media", links_sql("im", "PlaylistItemId", "IndependentMediaId"))
def _(v):
    return playlist.merge_media_maps(v.im, v.id_map, v.id_map).decisions.select("owner_id", "seq", "row_ord", "action")


@query("m19_item_places", links_sql("il", "PlaylistItemId", "LocationId"))
def _(v):
    return playlist.merge_location_maps(v.il, v.id_map, v.id_map).decisions.select("owner_id", "seq", "row_ord", "action")


@query("m20_markers", MAPPED.format(view="mkr", c="PlaylistItemId", to="item") + """, f as (select *, row_number() over (partition by owner_id, item, StartTimeTicks order by seq, row_ord) as n from r where item is not null)
    select owner_id, seq, row_ord, case when n = 1 then 'added' else 'reused' end as action from f where seq > 0 union all select owner_id, seq, row_ord, 'skipped' from r where item is null""")
def _(v):
    return playlist.merge_markers(v.mkr, v.id_map).decisions.select("owner_id", "seq", "row_ord", "action")


@query("m21_verses", MAPPED.format(view="vrs", c="PlaylistItemMarkerId", to="marker") + """, f as (select *, row_number() over (partition by owner_id, marker, VerseId order by seq, row_ord) as n from r where marker is not null)
    select owner_id, marker, cast(VerseId as bigint) as verse, count(*) as n from f where seq = 0 or n = 1 group by owner_id, marker, VerseId""")
def _(v):
    rows = playlist.merge_verse_maps(v.vrs, v.id_map).rows
    return rows.groupBy("owner_id", F.col("PlaylistItemMarkerId").alias("marker"), F.col("VerseId").cast("long").alias("verse")).agg(F.count("*").alias("n"))


@query("m22_paragraphs", MAPPED.format(view="par", c="PlaylistItemMarkerId", to="marker") + """, f as (select *, row_number() over (partition by owner_id, marker, MepsDocumentId, ParagraphIndex, MarkerIndexWithinParagraph order by seq, row_ord) as n from r where marker is not null)
    select owner_id, seq, row_ord, case when n = 1 then 'added' else 'reused' end as action from f where seq > 0""")
def _(v):
    return playlist.merge_paragraph_maps(v.par, v.id_map).decisions.select("owner_id", "seq", "row_ord", "action")


@query("m23_tag_maps", """with r as (select x.*, case when x.seq = 0 then x.TagId else t.target_id end as tag, case when x.seq = 0 then x.NoteId else n.target_id end as note from tag_note x
    left join id_map t on t.owner_id = x.owner_id and t.seq = x.seq and t.src_id = x.TagId left join id_map n on n.owner_id = x.owner_id and n.seq = x.seq and n.src_id = x.NoteId),
    f as (select *, row_number() over (partition by owner_id, tag, note order by seq, TagId, Position, row_ord) as n, max(case when seq = 0 then Position end) over (partition by owner_id, tag) as top from r where tag is not null and note is not null),
    a as (select *, case when seq = 0 then 'base' when n = 1 then 'added' else 'reused' end as action from f)
    select owner_id, seq, row_ord, action, cast(case when action = 'base' then Position when action = 'added' then coalesce(top, -1) + sum(case when action = 'added' then 1 else 0 end) over (partition by owner_id, tag order by seq, TagId, Position, row_ord) end as bigint) as final_position from a""")
def _(v):
    new = resolve.remap(resolve.remap(v.tag_note.filter("seq > 0"), "TagId", v.id_map, "tag"), "NoteId", v.id_map, "note").filter("tag is not null and note is not null")
    base = v.tag_note.filter("seq = 0").withColumns({"tag": F.col("TagId"), "note": F.col("NoteId")})
    return resolve.append_position(new.unionByName(base), "tag", "Position", ("TagId", "Position", "row_ord"), "note").select("owner_id", "seq", "row_ord", "action", "final_position")


@query("m23_tag_maps_final", """with r as (select x.*, t.target_id as tag, n.target_id as note from tag_note x
    left join id_map t on t.owner_id = x.owner_id and t.seq = x.seq and t.src_id = x.TagId left join id_map n on n.owner_id = x.owner_id and n.seq = x.seq and n.src_id = x.NoteId where x.seq > 0)
    select owner_id, seq, count(*) as skipped from r where tag is null or note is null group by owner_id, seq""")
def _(v):
    none = v.id_map.filter("false")
    return merge.merge_tag_maps(v.tag_note, v.id_map, none, none, v.id_map).decisions.filter("action = 'skipped'").groupBy("owner_id", "seq").agg(F.count("*").alias("skipped"))


@query("m24_stamp", "select distinct owner_id, '2026-01-01T00:00:00Z' as LastModified from ord")
def _(v):
    return merge.stamp_modified(v.ord, "2026-01-01T00:00:00Z")


def _tables(v) -> dict[str, DataFrame]:
    """A library whose references hold inside each snapshot, for whole-merge queries."""
    return {"Tag": v.tag, "Location": v.loc, "IndependentMedia": v.media, "grdb_migrations": v.mig, "PlaylistItemAccuracy": v.acc, "Note": v.note.withColumns({"UserMarkId": F.lit(None).cast("long"), "LocationId": F.lit(None).cast("long")})}


def _merged(v, *names: str) -> tuple[dict[str, DataFrame], jobs.Result]:
    """The whole merge; the merged tables named are written once, as a job would publish them."""
    t = _tables(v)
    done = jobs.merge_all(t, v.member, "2026-01-01T00:00:00Z")
    done.tables |= {n: cut(done.tables[n], n) for n in names}
    return t, done


WHOLE = "select owner_id, 'Tag' as tbl, count(*) as n from (select distinct owner_id, Type, Name from tag) a group by owner_id union all select owner_id, 'Note', count(*) from (select distinct owner_id, Guid from note) b group by owner_id union all select owner_id, 'grdb_migrations', count(*) from (select distinct owner_id, identifier from mig) c group by owner_id"


@query("m25_merge_all", WHOLE)
def _(v):
    _, done = _merged(v)
    return report.table_counts({n: done.tables[n] for n in ("Tag", "Note", "grdb_migrations")}).withColumnRenamed("table", "tbl")


# ---- verification: the merged library has lost every row whose number ends in 0 or 1

def damaged_sql(view: str, ident: str, shown: str) -> str:
    return f"""with s as (select *, {ident} as ident from {view}), m as (select distinct owner_id, ident from s where row_ord % 10 > 1)
    select s.owner_id, s.seq, s.row_ord, substr(coalesce({shown}, ''), 1, 40) as description from s left join m on m.owner_id = s.owner_id and m.ident = s.ident where m.ident is null"""


def _damaged(rows: DataFrame) -> DataFrame:
    return rows.filter("row_ord % 10 > 1")


def _with_row(missing: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """Each row whose identity is missing, once, also where several rows of a snapshot have it."""
    named = verify.simple_names(table, rows, "row_ord")
    return named.join(missing, ["owner_id", "seq", "identity"], "left_semi").select("owner_id", "seq", "row_ord", "description")


def _simple(name: str, table: str, view: str, ident: str, shown: str):
    @query(name, damaged_sql(view, ident, shown))
    def _(v):
        rows = getattr(v, view)
        return _with_row(verify.missing_simple(table, rows, _damaged(rows)), rows, table)


_simple("v1_missing_notes", "Note", "note", "Guid", "Title")
_simple("v2_missing_highlights", "UserMark", "mark", "UserMarkGuid", "UserMarkGuid")
_simple("v3_missing_tags", "Tag", "tag", "Type || '/' || Name", "Name")
_simple("v5_missing_media", "IndependentMedia", "media", "Hash", "OriginalFilename")

LOC_TEXT = " || '/' || ".join(f"coalesce('' || {c}, '~')" for c in LOCATION_IDENTITY)


@query("v4_missing_locations", f"select owner_id, seq, description, count(*) as n from ({damaged_sql('loc', LOC_TEXT, 'Title')}) x group by owner_id, seq, description")
def _(v):
    return verify.missing_locations(v.loc, _damaged(v.loc)).groupBy("owner_id", "seq", "description").agg(F.count("*").alias("n"))


#: Places of small numbers, the same on every device, so that bookmarks and answers have an identity to compare.
PLACES = "select owner_id, seq, src_id as row_ord, src_id as LocationId, target_id % 80 as ident from id_map"


def _places(v) -> DataFrame:
    rows = v.sql(PLACES)
    none = {c: F.lit(None).cast("string") for c in LOCATION_IDENTITY if c != "DocumentId"}
    return rows.withColumns({"DocumentId": F.col("ident"), **none})


@query("v6_missing_bookmarks", f"""with p as ({PLACES}), s as (select b.owner_id, b.seq, b.row_ord, coalesce('' || x.ident, '~') || '/' || coalesce('' || y.ident, '~') as ident, Title from bkm b
    left join p x on x.owner_id = b.owner_id and x.seq = b.seq and x.LocationId = b.PublicationLocationId left join p y on y.owner_id = b.owner_id and y.seq = b.seq and y.LocationId = b.LocationId),
    m as (select distinct owner_id, ident from s where row_ord % 10 > 1) select s.owner_id, s.seq, Title as description from s left join m on m.owner_id = s.owner_id and m.ident = s.ident where m.ident is null""")
def _(v):
    return verify.missing_bookmarks(v.bkm, _places(v), _damaged(v.bkm), _places(v)).select("owner_id", "seq", "description")


@query("v7_missing_answers", f"""with p as ({PLACES}), s as (select b.owner_id, b.seq, b.row_ord, coalesce('' || x.ident, '~') || '/' || TextTag as ident, TextTag from ans b
    left join p x on x.owner_id = b.owner_id and x.seq = b.seq and x.LocationId = b.LocationId),
    m as (select distinct owner_id, ident from s where row_ord % 10 > 1) select s.owner_id, s.seq, TextTag as description, count(*) as n from s left join m on m.owner_id = s.owner_id and m.ident = s.ident where m.ident is null group by s.owner_id, s.seq, TextTag""")
def _(v):
    return verify.missing_answers(v.ans, _places(v), _damaged(v.ans), _places(v)).groupBy("owner_id", "seq", "description").agg(F.count("*").alias("n"))


ITEM_TEXT = "tag_name || '/' || Label || '/' || coalesce('' || StartTrimOffsetTicks, '~') || '/' || EndAction || '/' || coalesce(thumb, '~') || '/' || coalesce('' || med, '~') || '/' || coalesce('' || dur, '~') || '/' || coalesce('' || plc, '~') || '/' || coalesce('' || kind, '~')"


@query("v8_missing_items", f"""{ITEM_KEY}, s as (select owner_id, seq, row_ord, Label, {ITEM_TEXT} as ident from k), m as (select distinct owner_id, ident from s where seq = 0 and row_ord % 10 > 1)
    select s.owner_id, s.seq, s.Label as description, count(*) as n from s left join m on m.owner_id = s.owner_id and m.ident = s.ident where m.ident is null group by s.owner_id, s.seq, s.Label""")
def _(v):
    src = {"PlaylistItem": v.item, "TagMap": v.item_tag, "Tag": v.ptag, "IndependentMedia": v.pmedia, "PlaylistItemIndependentMediaMap": v.pmm, "PlaylistItemLocationMap": v.plm, "Location": v.ploc}
    base = {n: df.filter("seq = 0").drop("seq", "row_ord") for n, df in src.items()}
    base["PlaylistItem"] = base["PlaylistItem"].filter("PlaylistItemId % 10 > 1")
    return verify.missing_items(src, base).groupBy("owner_id", "seq", "description").agg(F.count("*").alias("n"))


@query("v9_missing_files", "select owner_id, seq, row_ord from media m where not exists (select 1 from member x where x.owner_id = m.owner_id and x.seq = m.seq and x.member = m.FilePath)")
def _(v):
    return verify.missing_files(v.media, v.member).select("owner_id", "seq", "row_ord")


@query("v10_checked_and_ok", """with m as (select distinct owner_id, Guid from note where row_ord % 1000 > 1),
    x as (select n.owner_id, count(*) as missing from note n left join m on m.owner_id = n.owner_id and m.Guid = n.Guid where m.Guid is null group by n.owner_id)
    select c.owner_id, c.checked, coalesce(x.missing, 0) as missing, x.missing is null as ok from (select owner_id, count(*) as checked from note group by owner_id) c left join x on x.owner_id = c.owner_id""")
def _(v):
    missing = verify.missing_simple("Note", v.note, v.note.filter("row_ord % 1000 > 1"))
    return verify.verdicts(v.note, missing).join(verify.checked({"Note": v.note}).drop("table"), "owner_id").select("owner_id", "checked", "missing", "ok")


@query("v11_first_missing", """with m as (select distinct owner_id, UserMarkGuid from mark where row_ord % 10 > 1), s as (select x.owner_id, x.seq, x.UserMarkGuid as description from mark x left join m on m.owner_id = x.owner_id and m.UserMarkGuid = x.UserMarkGuid where m.owner_id is null)
    select owner_id, least(count(*), 50) as listed from s group by owner_id""")
def _(v):
    missing = verify.missing_simple("UserMark", v.mark, _damaged(v.mark))
    return verify.first_missing(missing).groupBy("owner_id").agg(F.count("*").alias("listed"))


@query("v12_references", """select n.owner_id, 'Note' as tbl, 'LocationId' as col, count(*) as n from note n where LocationId is not null and not exists (select 1 from id_map m where m.owner_id = n.owner_id and m.target_id = n.LocationId) group by n.owner_id
    union all select i.owner_id, 'TagMap', 'TagId', count(*) from tag_note i where not exists (select 1 from id_map t where t.owner_id = i.owner_id and t.target_id = i.TagId) group by i.owner_id""")
def _(v):
    one = v.id_map.select("owner_id", F.col("target_id").alias("LocationId"), F.col("target_id").alias("TagId")).distinct()
    broken = verify.broken_references({"Note": v.note, "Location": one, "Tag": one, "TagMap": v.tag_note})
    broken = broken.filter("parent in ('Location', 'Tag') and not (table = 'TagMap' and column = 'LocationId')")
    return broken.groupBy("owner_id", F.col("table").alias("tbl"), F.col("column").alias("col")).agg(F.sum("rows").alias("n"))


@query("v13_constraints", """select owner_id, 'Tag' as tbl, 'unique: Type, Name' as rule, cast(sum(n) as bigint) as n from (select owner_id, Type, Name, count(*) as n from tag group by owner_id, Type, Name having count(*) > 1) x group by owner_id
    union all select owner_id, 'Tag', 'unique: TagId', cast(sum(n) as bigint) from (select owner_id, TagId, count(*) as n from tag group by owner_id, TagId having count(*) > 1) x group by owner_id
    union all select owner_id, 'PlaylistItem', 'check: end action', count(*) from item where EndAction + 2 not in (0, 1, 2, 3) group by owner_id""")
def _(v):
    found = verify.violations({"Tag": v.tag, "PlaylistItem": v.item.withColumn("EndAction", F.col("EndAction") + 2).drop("PlaylistItemId").withColumn("PlaylistItemId", F.lit(None).cast("long"))})
    return found.select("owner_id", F.col("table").alias("tbl"), "rule", F.col("rows").alias("n"))


@query("v14_self_verify", "select distinct owner_id, cast(0 as bigint) as missing, true as ok from tag")
def _(v):
    none = v.id_map.filter("false")
    done = {"Tag": merge.merge_tags(v.tag), "Location": merge.merge_locations(v.loc), "IndependentMedia": _media(v)[0], "Note": merge.merge_notes(v.note, none, none)}
    merged = {n: cut(m.rows, n) for n, m in done.items()}
    own = {n: df.withColumn("seq", F.lit(0)) for n, df in merged.items()}
    missing = [verify.missing_simple(n, own[n], merged[n]) for n in ("Tag", "IndependentMedia", "Note")] + [verify.missing_locations(own["Location"], merged["Location"])]
    return verify.verdicts(v.tag, report.conflict_list(*missing))


@query("v15_idempotence", "select owner_id, 0 as again from tag where 1 = 0")
def _(v):
    none = v.id_map.filter("false")
    merges = {"Tag": merge.merge_tags, "PlaylistItemAccuracy": merge.merge_accuracies, "Note": lambda rows: merge.merge_notes(rows, none, none)}
    t = {"Tag": v.tag, "PlaylistItemAccuracy": v.acc, "Note": v.note}
    base = jobs.as_base({n: cut(f(t[n]).rows, n) for n, f in merges.items()})
    again = [f(base[n].unionByName(t[n].withColumn("seq", F.col("seq") + 1))).decisions for n, f in merges.items()]
    return verify.added_again(report.conflict_list(*again)).groupBy("owner_id").agg(F.count("*").cast("int").alias("again"))


# ---- reports

@query("a1_table_counts", "select owner_id, seq, 'Note' as tbl, count(*) as n from note group by owner_id, seq union all select owner_id, seq, 'UserMark', count(*) from mark group by owner_id, seq union all select owner_id, seq, 'Tag', count(*) from tag group by owner_id, seq")
def _(v):
    return report.table_counts({"Note": v.note, "UserMark": v.mark, "Tag": v.tag}, "owner_id", "seq").withColumnRenamed("table", "tbl")


ACTIONS = "count(case when action = 'added' then 1 end) as added, count(case when action = 'updated' then 1 end) as updated, count(case when action = 'reused' then 1 end) as reused, count(case when action = 'skipped' then 1 end) as skipped"


@query("a2_action_counts", MARKS + f", d as (select owner_id, seq, action from e where action <> 'base' union all select owner_id, seq, 'skipped' from r where place is null) select owner_id, seq, 'UserMark' as tbl, {ACTIONS} from d group by owner_id, seq")
def _(v):
    return report.action_counts(merge.merge_marks(v.mark, v.rng, _ids(v))[0].decisions).withColumnRenamed("table", "tbl")


@query("a3_totals", "with b as (select owner_id, count(*) as x from tag where seq = 0 group by owner_id), a as (select owner_id, count(*) as y from (select distinct owner_id, Type, Name from tag) t group by owner_id) select a.owner_id, 'Tag' as tbl, coalesce(x, 0) as before, y as after, y - coalesce(x, 0) as difference from a left join b on b.owner_id = a.owner_id")
def _(v):
    before, after = report.table_counts({"Tag": v.tag.filter("seq = 0")}), report.table_counts({"Tag": merge.merge_tags(v.tag).rows})
    return report.totals(before, after).withColumnRenamed("table", "tbl")


@query("a4_media_counts", f"""{NEW_MEDIA}, d as (select f.owner_id, f.seq, f.n = 1 as fresh, coalesce(z.present, false) as present, coalesce(z.renamed, false) as renamed from f left join z on z.owner_id = f.owner_id and z.seq = f.seq and z.row_ord = f.row_ord where f.seq > 0)
    select owner_id, seq, count(case when fresh and present then 1 end) as media_added, count(case when not fresh then 1 end) as media_reused, count(case when renamed then 1 end) as media_renamed from d group by owner_id, seq""")
def _(v):
    done = merge.merge_media(v.media, v.member)[0]
    return report.media_counts(done.decisions, done.renames)


@query("a5_conflicts", ANSWERS + """ select owner_id, seq, 'InputField' as tbl, 'answer ' || TextTag || ' differs' as detail, count(*) as n from f where seq > 0 and n > 1 and Value <> head group by owner_id, seq, TextTag""")
def _(v):
    listed = report.conflict_list(merge.merge_answers(v.ans, v.id_map).conflicts)
    return listed.groupBy("owner_id", "seq", F.col("table").alias("tbl"), "detail").agg(F.count("*").alias("n"))


@query("a6_summary", "with a as (select owner_id, count(*) - count(case when seq0 then 1 end) as new_rows from (select owner_id, Type, Name, max(case when seq = 0 then 1 else 0 end) = 1 as seq0 from tag group by owner_id, Type, Name) x group by owner_id) select owner_id, new_rows, case when owner_id % 3 = 0 then 'CHECK FAILED' else 'verified' end as verdict from a")
def _(v):
    ok = v.tag.select("owner_id").distinct().withColumn("ok", F.col("owner_id") % 3 != 0)
    return report.summary(merge.merge_tags(v.tag).decisions, ok)


@query("a7_digest", MARKS + " select owner_id, seq, count(*) as changed from e where action in ('added', 'updated') group by owner_id, seq")
def _(v):
    marks, ranges = merge.merge_marks(v.mark, v.rng, _ids(v))
    return report.digest(marks.decisions.union(ranges.decisions))


@query("a8_device_counts", "select owner_id, count(distinct name) as devices from (select owner_id, 'old' as name from snap where snapshot_id % 5 = 0 union all select owner_id, coalesce(nullif(device, ''), file) from snap) x group by owner_id")
def _(v):
    return report.device_counts(v.snap.filter("snapshot_id % 5 = 0").select("owner_id", F.lit("old").alias("name")), v.snap)


@query("a9_stored_summary", "select owner_id, count(*) as tables, cast(sum(n) as bigint) as total from (select owner_id, 'n' as t, count(*) as n from note group by owner_id union all select owner_id, 't', count(*) from tag group by owner_id) x group by owner_id")
def _(v):
    stored = report.stored_summary(report.table_counts({"Note": v.note, "Tag": v.tag}))
    return stored.select("owner_id", F.size("summary").cast("long").alias("tables"), F.aggregate(F.map_values("summary"), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


# ---- manifests

NESTED = '{"deep":[1,{"a":null,"b":"x"}],"n":#}'


@query("s3_manifest_round_trip", "select owner_id, snapshot_id, device as device_name, '" + NESTED.replace("#", "' || snapshot_id || '") + "' as odd, '[' || owner_id || ',true,1.5]' as more from snap")
def _(v):
    """Manifests with nested fields that no reader knows, read and written back."""
    odd = F.concat(F.lit(NESTED.split("#")[0]), F.col("snapshot_id").cast("string"), F.lit(NESTED.split("#")[1]))
    more = F.concat(F.lit("["), F.col("owner_id").cast("string"), F.lit(",true,1.5]"))
    known = F.to_json(F.struct(F.lit(16).alias("schemaVersion"), F.col("device").alias("deviceName")))
    inner = F.concat(F.regexp_replace(known, r"\}$", ',"more":'), more, F.lit("}"))
    text = F.concat(F.lit('{"name":"n","version":1,"odd":'), odd, F.lit(',"userDataBackup":'), inner, F.lit("}"))
    back = v.snap.select("owner_id", "snapshot_id", archives.write_manifest(archives.parse_manifest(text)).alias("j"))
    return back.select("owner_id", "snapshot_id", *(F.get_json_object("j", p).alias(n) for n, p in (("device_name", "$.userDataBackup.deviceName"), ("odd", "$.odd"), ("more", "$.userDataBackup.more"))))


# ---- incremental

@query("i1_folder_fingerprints", "select owner_id, poll, count(*) as files from (select distinct owner_id, poll, name, size, mtime from listing) x group by owner_id, poll")
def _(v):
    # equal sets have equal fingerprints, whatever the order and the repeats of their files
    twice = v.listing.union(v.listing.orderBy(F.desc("size")))
    both = incremental.fingerprints(v.listing, "owner_id", "poll").join(incremental.fingerprints(twice, "owner_id", "poll"), ["owner_id", "poll", "fingerprint"])
    files = v.listing.groupBy("owner_id", "poll").agg(F.countDistinct("name", "size", "mtime").alias("files"))
    return files.join(both, ["owner_id", "poll"]).select("owner_id", "poll", "files")


@query("i2_changed", """with s as (select distinct owner_id, name, size from listing), n as (select owner_id, max(mtime) as top from listing group by owner_id)
    select owner_id from n where owner_id % 3 <> 0 and owner_id % 5 <> 0""")
def _(v):
    now = incremental.fingerprints(v.listing)
    state = now.withColumn("fingerprint", F.when(F.col("owner_id") % 3 == 0, F.col("fingerprint")).otherwise(F.lit("old"))).filter("owner_id % 5 <> 1")
    return incremental.changed(now, state).filter("owner_id % 5 <> 0 and owner_id % 3 <> 0").select("owner_id")


@query("i2_changed_whole", "select distinct owner_id from listing where owner_id % 3 <> 0 or owner_id % 5 = 1")
def _(v):
    now = incremental.fingerprints(v.listing)
    state = now.withColumn("fingerprint", F.when(F.col("owner_id") % 3 == 0, F.col("fingerprint")).otherwise(F.lit("old"))).filter("owner_id % 5 <> 1")
    return incremental.changed(now, state).select("owner_id")


@query("i3_settle", """with recursive p as (select owner_id, poll, fingerprint, merge_ok, row_number() over (partition by owner_id order by poll) as n from polls),
    s as (select owner_id, n, poll, cast(null as string) as merged, fingerprint as candidate, false as merge from p where n = 1
      union all select p.owner_id, p.n, p.poll, case when s.merged is distinct from p.fingerprint and s.candidate is not distinct from p.fingerprint and p.merge_ok then p.fingerprint else s.merged end,
        case when s.merged is not distinct from p.fingerprint then s.candidate when s.candidate is not distinct from p.fingerprint then null else p.fingerprint end,
        s.merged is distinct from p.fingerprint and s.candidate is not distinct from p.fingerprint from s join p on p.owner_id = s.owner_id and p.n = s.n + 1)
    select owner_id, poll, merge from s""")
def _(v):
    return incremental.settle(v.polls)


@query("i4_content_changed", "select owner_id, not (owner_id % 4 <> 0 and owner_id % 3 <> 0) as run from (select distinct owner_id from snap) x")
def _(v):
    now = v.snap.select("owner_id", F.col("file").alias("name"), F.sha2("device", 256).alias("digest"))
    last = now.withColumn("digest", F.when(F.col("owner_id") % 4 == 0, F.lit("other")).otherwise(F.col("digest")))
    return incremental.content_changed(now, last, v.snap.filter("owner_id % 3 <> 0"))


@query("i5_next_state", "select owner_id, case when owner_id % 2 = 0 and owner_id % 3 <> 0 then 'new' else 'old' end as fingerprint from (select distinct owner_id from snap) x")
def _(v):
    owners = v.snap.select("owner_id").distinct()
    return incremental.next_state(owners.withColumn("fingerprint", F.lit("old")), owners.filter("owner_id % 2 = 0").withColumn("fingerprint", F.lit("new")).withColumn("ok", F.col("owner_id") % 3 != 0))


@query("i6_accumulate", "select distinct owner_id, Type, Name from tag where seq < 3")
def _(v):
    first = merge.merge_tags(v.tag.filter("seq < 2")).rows
    second = jobs.as_base({"Tag": first})["Tag"].unionByName(v.tag.filter("seq = 2"))
    return merge.merge_tags(second).rows.select("owner_id", "Type", "Name")


@query("i7_fresh_rebuild", f"select owner_id, snapshot_id from (select *, row_number() over (partition by owner_id order by {STAMP} desc, input_ord) as n from snap where not is_stable) x where n = 1")
def _(v):
    return ordering.with_seq_accumulating(v.snap, fresh=True).filter("seq = 0").select("owner_id", "snapshot_id")


@query("i8_device_registry", "select owner_id, device, max(last_modified) as last_modified, min(seen_at) as first_seen, max(seen_at) as seen_at from sight group by owner_id, device")
def _(v):
    old = v.sight.filter("half = 0").groupBy("owner_id", "device").agg(F.max("last_modified").alias("last_modified"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("seen_at"))
    return incremental.devices(old, v.sight.filter("half = 1").drop("half"))


@query("i9_owner_isolation", "select owner_id, count(*) as tags from (select distinct owner_id, Type, Name from tag) x where owner_id % 2 = 1 group by owner_id")
def _(v):
    whole = jobs.restrict({"Tag": v.tag}, v.tag.filter("owner_id % 2 = 1"))
    return merge.merge_tags(whole["Tag"]).rows.groupBy("owner_id").agg(F.count("*").alias("tags"))


@query("i10_owner_list", "select owner_id, name, updated, library is not null as has_library from own")
def _(v):
    return incremental.owner_list(v.own)


@query("i11_forget_delete_rename", "select owner_id, case when owner_id % 4 = 0 then 'new' || owner_id else name end as name, updated, case when owner_id % 5 <> 0 then library end as library, case when owner_id % 5 <> 0 then summary end as summary from own where owner_id % 7 <> 0")
def _(v):
    names = v.own.filter("owner_id % 2 = 0").select("owner_id", F.when(F.col("owner_id") % 4 == 0, F.concat(F.lit("new"), "owner_id")).otherwise(" ").alias("new_name"))
    forgot = incremental.forget_library(v.own, v.own.filter("owner_id % 5 = 0"))
    return incremental.rename_owners(incremental.delete_owners(forgot, v.own.filter("owner_id % 7 = 0")), names)


@query("i12_publishable", "select distinct owner_id from snap where owner_id in (select owner_id from own) and owner_id % 3 <> 0 and owner_id % 5 <> 0")
def _(v):
    results = v.snap.select("owner_id", (F.col("owner_id") % 3 != 0).alias("ok"), F.when(F.col("owner_id") % 5 == 0, 1).otherwise(0).alias("integrity_errors")).distinct()
    return incremental.publishable(results, v.own).select("owner_id")


# ---- sources, sinks and functions over plain columns

@query("s4_manifest_fallback", "select owner_id, cast(max(cast(regexp_extract(identifier, '^v([0-9]+)$', 1) as integer)) as bigint) as version from mig group by owner_id")
def _(v):
    return v.mig.groupBy("owner_id").agg(F.max(keys.migration_version(F.col("identifier"))).alias("version"))


LISTED = "select page_id as input_ord, page_id % 20 as owner_id, case page_id % 6 when 0 then 'a' || page_id || '.lib' when 1 then '.b' || page_id || '.lib.icloud' when 2 then '.hidden.lib' when 3 then 'other' || page_id || '.txt' when 4 then 'out' || page_id || '.lib' else 'd.lib' end as name from pages"


@query("s5_discover", f"select owner_id, name, 'input' as kind from ({LISTED}) x where name like '%.lib' and name not like '.%' and name not like 'out%' union all select owner_id, substr(name, 2, length(name) - 8), 'pending' from ({LISTED}) y where name like '.%.lib.icloud'")
def _(v):
    from snapfold.sources.archives import discover, pending

    listed = v.sql(LISTED)
    outputs = listed.filter("name like 'out%'").select("owner_id", "name")
    return discover(listed, outputs, ".lib").select("owner_id", "name", F.lit("input").alias("kind")).union(pending(listed, ".lib").select("owner_id", "name", F.lit("pending")))


@query("s9_run_log", "select owner_id, event_id as at from (select user_id as owner_id, event_id, row_number() over (partition by user_id order by event_id desc) as n from events) x where n <= 20")
def _(v):
    return incremental.keep_runs(v.sql("select user_id as owner_id, event_id as at from events"))


@query("s10_device_name", "select snapshot_id, case when trim(device) = '' then file || ' (merged)' else device end as device from snap")
def _(v):
    return v.snap.select("snapshot_id", incremental.device_name(F.col("device"), F.col("file")).alias("device"))


@query("f1_short_hex", r"select doc_id, regexp_replace(sha256(coalesce(text, '')), '0([0-9a-f])|([1-9a-f][0-9a-f])', '\1\2', 'g') as hash from documents")
def _(v):
    return v.sql("select doc_id, text from documents").select("doc_id", keys.media_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))


@query("f3_sha256", "select doc_id, sha256(text) as digest from documents where text is not null")
def _(v):
    return v.sql("select doc_id, text from documents where text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("f4_unique_name", """select k, case when k % 4 = 0 then 'm.lib' else 'm-' || (2 + k % 4) || '.lib' end as name from (select distinct k from ord) x""")
def _(v):
    k = v.sql("select distinct k from ord")
    taken = F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("m.lib")), F.transform(F.sequence(F.lit(2), (F.col("k") % 4 + 1).cast("int")), lambda n: F.concat(F.lit("m-"), n.cast("string"), F.lit(".lib")))))
    return k.select("k", keys.unique_name(F.lit("m.lib"), taken).alias("name"))


@query("f5_null_safe_key", "select Specialty as specialty, count(*) as n from loc group by Specialty")
def _(v):
    return v.loc.groupBy(keys.key("Specialty").alias("k"), F.col("Specialty").alias("specialty")).agg(F.count("*").alias("n")).select("specialty", "n")


@query("f6_names", "select snapshot_id, 'd' || snapshot_id || '.x' as stem, '.lib' as suffix from snap")
def _(v):
    path = F.concat(F.lit("some/dir/d"), "snapshot_id", F.lit(".x.lib"))
    return v.snap.select("snapshot_id", keys.stem(path).alias("stem"), keys.suffix(path).alias("suffix"))


@query("f7_stamps", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp from events")
def _(v):
    return v.sql("select event_id, ts from events").select("event_id", keys.utc_stamp(F.col("ts")).alias("stamp"))


@query("w2_verify_all")
def _(v):
    none = v.id_map.filter("false")
    t = {"Tag": v.tag, "Location": v.loc, "IndependentMedia": v.media, "Note": v.note}
    done = {"Tag": merge.merge_tags(v.tag), "Location": merge.merge_locations(v.loc), "IndependentMedia": _media(v)[0], "Note": merge.merge_notes(v.note, none, none)}
    empty = {n: jobs.empty(v.spark, n) for n in TABLES}
    merged = {n: df.drop("seq", "row_ord") for n, df in empty.items()} | {n: cut(m.rows, n) for n, m in done.items()}
    return jobs.verify_all(empty | t, merged).groupBy("owner_id", "table").agg(F.count("*").alias("missing"))


@query("s8_report_json")
def _(v):
    done = merge.merge_marks(v.mark, v.rng, _ids(v))[0]
    counts = report.totals(report.table_counts({"UserMark": v.mark.filter("seq = 0")}), report.table_counts({"UserMark": done.rows}))
    answers = merge.merge_answers(v.ans, v.id_map)
    return report.report_json(report.action_counts(done.decisions.union(answers.decisions)), answers.conflicts, counts)


def _reported(v):
    marks, answers = merge.merge_marks(v.mark, v.rng, _ids(v))[0], merge.merge_answers(v.ans, v.id_map)
    counts = report.totals(report.table_counts({"UserMark": v.mark.filter("seq = 0")}), report.table_counts({"UserMark": marks.rows}))
    return report.action_counts(marks.decisions), answers.conflicts, counts


MARK_ACTIONS = f", d as (select owner_id, seq, action from e where action <> 'base' union all select owner_id, seq, 'skipped' from r where place is null), ac as (select owner_id, seq, {ACTIONS} from d group by owner_id, seq)"
MARK_TOTALS = ", af as (select owner_id, count(distinct UserMarkGuid) as y from e group by owner_id), be as (select owner_id, count(*) as x from mark where seq = 0 group by owner_id)"


@query("s8_report_text", MARKS + MARK_ACTIONS + MARK_TOTALS + """ select owner_id, '1|' || seq || '|UserMark' as line_ord, 'source ' || seq || ', UserMark: ' || added || ' added, ' || updated || ' updated, ' || reused || ' reused, ' || skipped || ' skipped' as line from ac
    union all select af.owner_id, '2|UserMark', 'UserMark: ' || coalesce(x, 0) || ' -> ' || y || ' (' || case when y >= coalesce(x, 0) then '+' else '' end || (y - coalesce(x, 0)) || ')' from af left join be on be.owner_id = af.owner_id""")
def _(v):
    actions, _, counts = _reported(v)
    return report.report_text(actions, counts)


@query("s8_report_parsed", ANSWERS.replace("with r as", "with ra as", 1).replace("from r where", "from ra where") + """, ca as (select owner_id, seq, 'answer ' || TextTag || ' differs' as detail from f where seq > 0 and n > 1 and Value <> head), """
    + MARKS.replace("with r as", "r as", 1).replace(" f as (", " fm as (").replace("from f)", "from fm)") + MARK_ACTIONS + MARK_TOTALS + """
    select owner_id, 'conflict' as what, seq || '|InputField|' || detail as text, count(*) as n from ca group by owner_id, seq, detail
    union all select owner_id, 'conflicts', '', count(*) from ca group by owner_id
    union all select owner_id, 'source', seq || '|UserMark|' || added || '|' || updated || '|' || reused || '|' || skipped, 1 from ac
    union all select af.owner_id, 'total', 'UserMark|' || coalesce(x, 0) || '|' || y, 1 from af left join be on be.owner_id = af.owner_id""")
def _(v):
    """The JSON report, read back: every conflict of every part, the numbers of conflicts, the counters and the totals."""
    kind = "struct<sources:array<struct<seq:int,tables:array<struct<table:string,added:long,updated:long,reused:long,skipped:long>>>>,totals:array<struct<table:string,before:long,after:long>>,n_conflicts:long,conflicts:array<struct<seq:int,table:string,detail:string>>>"
    parts = report.report_json(*_reported(v), limit=500).select("owner_id", "part", F.from_json("report", kind).alias("r"))
    text = lambda *c: F.concat_ws("|", *(F.col(x).cast("string") for x in c))
    conflicts = parts.select("owner_id", F.explode("r.conflicts").alias("c")).groupBy("owner_id", text("c.seq", "c.table", "c.detail").alias("text")).agg(F.count("*").alias("n"))
    numbers = parts.filter("r.n_conflicts > 0").select("owner_id", F.lit("conflicts").alias("what"), F.lit("").alias("text"), F.col("r.n_conflicts").alias("n"))
    each = parts.select("owner_id", F.explode("r.sources").alias("s")).select("owner_id", "s.seq", F.explode("s.tables").alias("t"))
    counters = each.select("owner_id", F.lit("source"), text("seq", "t.table", "t.added", "t.updated", "t.reused", "t.skipped"), F.lit(1).cast("long"))
    sums = parts.select("owner_id", F.explode("r.totals").alias("t")).select("owner_id", F.lit("total"), text("t.table", "t.before", "t.after"), F.lit(1).cast("long"))
    return conflicts.select("owner_id", F.lit("conflict").alias("what"), "text", "n").union(numbers).union(counters).union(sums)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all snapshots merged, counted by action, and verified."""
    v = Views(ship(spark), sf_dir)
    done = merge.merge_tags(v.tag)
    missing = verify.missing_simple("Tag", v.tag, done.rows).groupBy("owner_id").agg(F.count("*").alias("missing"))
    return report.action_counts(done.decisions).join(missing, "owner_id", "left").fillna(0, ["missing"])

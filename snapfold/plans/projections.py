"""Device snapshots projected from plain tables, in SQL that Spark and DuckDB share.

Four devices (d, used as seq) hold a row of key k if (k * 7 + d * 13) % 5 <> 0 and have edited it if (k + d) % 3 = 0. Owner
0 is the large one. Ids of parents are shifted by 1000 * d, so every reference has to be mapped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "dev": "select 0 as d union all select 1 union all select 2 union all select 3",
    "ord": """select o_orderkey as k, d, case when o_custkey % 5 = 0 then 0 else o_custkey % 16 end as owner_id, o_custkey as c,
        o_orderpriority as pri, cast(o_orderdate as date) as dy from orders, dev where (o_orderkey * 7 + d * 13) % 5 <> 0""",
    "prt": """select p_partkey as k, d, case when p_partkey % 5 = 0 then 0 else p_partkey % 4 end as owner_id, p_brand, p_type,
        cast(p_size as bigint) as sz from part, dev where (p_partkey * 7 + d * 13) % 5 <> 0""",
    "id_map": """select o.p_partkey - 1 as owner_id, d as seq, i.p_partkey - 1 + 1000 * d as src_id, i.p_partkey - 1 as target_id
        from part o, part i, dev where o.p_partkey <= 16 and i.p_partkey <= 97 and i.p_partkey % 17 <> 3""",
    "snap": """select o_custkey as owner_id, o_orderkey as snapshot_id, o_orderkey as input_ord,
        case when o_orderkey % 7 = 0 then '' else cast(cast(o_orderdate as date) as string) || 'T00:00:00+0000' end as last_modified,
        cast(cast(o_orderdate as date) as string) || 'T01:00:00+0000' as creation_date,
        case when o_custkey % 9 = 0 and o_orderkey % 3 = 0 then 15 when o_custkey % 31 = 0 then 13 else 16 end as schema_version,
        o_orderkey % 11 = 0 as is_stable, case when o_orderkey % 13 = 0 then '' else o_orderpriority end as device,
        'file' || o_orderkey as file from orders""",
    "tag": """select owner_id, d as seq, min(k) as row_ord, min(k) as TagId, sz % 3 as Type, p_type as Name
        from prt group by owner_id, d, sz % 3, p_type""",
    "tag_note": """select owner_id, d as seq, k as row_ord, k as TagMapId, cast(null as bigint) as PlaylistItemId, cast(null as bigint) as LocationId,
        (k * 3) % 89 + 1000 * d as NoteId, c % 11 + 1000 * d as TagId, k as Position from ord where k % 4 = 0""",
    "loc": """select owner_id, d as seq, k as row_ord, k as LocationId, case when k % 3 = 0 then sz end as BookNumber,
        case when k % 3 = 0 then k % 7 end as ChapterNumber, case when k % 3 = 1 then k % 60 end as DocumentId,
        case when k % 3 = 1 then sz end as Track, cast(0 as bigint) as IssueTagNumber, p_brand as KeySymbol, cast(294 as bigint) as MepsLanguage,
        cast(0 as bigint) as Type, p_type as Title, case when k % 4 = 0 then '' when k % 4 = 1 then 's' || d end as Specialty, cast(null as string) as Edition
        from (select *, row_number() over (partition by owner_id, d, p_brand, k % 3, case k % 3 when 0 then sz * 100 + k % 7 when 1 then sz * 100 + k % 60 else k end order by k) as n from prt) x
        where n = 1""",
    "media": """select owner_id, seq, row_ord, row_ord as IndependentMediaId, source as OriginalFilename, FilePath, 'audio/mp3' as MimeType, Hash from (
        select doc_id % 8 as owner_id, cast((doc_id / 8) % 4 as int) as seq, doc_id as row_ord, source,
          source || case when doc_id % 32 < 8 then '-' || doc_id else '' end || '.mp3' as FilePath, sha256(text) as Hash,
          row_number() over (partition by doc_id % 8, cast((doc_id / 8) % 4 as int), case when doc_id % 32 < 8 then '' || doc_id else source end order by doc_id) as n
        from (select doc_id, coalesce(source, 's') as source, text from documents) t) x where n = 1""",
    "member": "select owner_id, seq, FilePath as member from media where row_ord % 11 <> 0 union all select owner_id, 0 as seq, OriginalFilename || '.mp3' from media where row_ord % 5 = 0",
    "mark": """select owner_id, d as seq, l_orderkey * 8 + l_linenumber as row_ord, l_orderkey * 8 + l_linenumber as UserMarkId, cast(l_linenumber % 6 as bigint) as ColorIndex,
        (l_orderkey + l_linenumber) % 97 + 1000 * d as LocationId, cast(d as bigint) as StyleIndex, l_orderkey || '-' || l_linenumber as UserMarkGuid,
        case when l_orderkey % 10 = 0 and d > 0 then cast(null as bigint) else 1 + (l_orderkey * (d + 1)) % 4 end as Version
        from (select distinct l_orderkey, l_linenumber from lineitem) l join ord on k = l_orderkey""",
    "rng": """select owner_id, d as seq, row_number() over (partition by owner_id, d order by l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey) as row_ord,
        cast(1 as bigint) as BlockRangeId, cast(1 as bigint) as BlockType, cast(l_linenumber as bigint) as Identifier, cast(l_quantity as bigint) % 5 as StartToken,
        case when l_orderkey % 6 = 0 then cast(null as bigint) else cast(l_quantity as bigint) % 5 + (l_orderkey + d) % 3 end as EndToken, l_orderkey * 8 + l_linenumber as UserMarkId
        from lineitem join ord on k = l_orderkey""",
    "note": """select owner_id, d as seq, k as row_ord, k as NoteId, 'n' || k as Guid, (k * 5) % 89 + 1000 * d as UserMarkId, case when k % 8 = 0 then 0 else k % 97 + 1000 * d end as LocationId,
        case when k % 50 = 0 then null else pri end as Title, case when (k + d) % 3 = 0 then 'edit' || d when k % 7 = 0 then '' when k % 7 = 1 then null else 'v0' end as Content,
        cast(dy + cast((k * d) % 3 as int) as string) || 'T00:00:00Z' as LastModified, cast(dy as string) || 'T00:00:00Z' as Created,
        cast(0 as bigint) as BlockType, cast(null as bigint) as BlockIdentifier from ord""",
    "bkm": """select owner_id, seq, row_ord, row_ord as BookmarkId, LocationId, PublicationLocationId, rk - 1 as Slot, 'b' || row_ord as Title, cast(null as string) as Snippet,
        cast(0 as bigint) as BlockType, cast(null as bigint) as BlockIdentifier from (
        select *, row_number() over (partition by owner_id, seq, PublicationLocationId order by row_ord) as rk from (
          select owner_id, seq, min(row_ord) as row_ord, LocationId, PublicationLocationId from (
            select owner_id, d as seq, k as row_ord, (k * 11) % 97 + 1000 * d as LocationId, c % 23 + 1000 * d as PublicationLocationId from ord where k % 3 = 0) a
          group by owner_id, seq, LocationId, PublicationLocationId) b) e where rk <= 10""",
    "ans": """select owner_id, d as seq, min(k) as row_ord, c % 50 + 1000 * d as LocationId, pri as TextTag,
        'a' || (min(k) % 5) || case when (min(k) + d) % 3 = 0 then '-' || d else '' end as Value from ord group by owner_id, d, c % 50 + 1000 * d, pri""",
    "acc": "select distinct owner_id, d as seq, cast(sz % 7 as bigint) as row_ord, cast(sz % 7 as bigint) as PlaylistItemAccuracyId, 'accuracy ' || ((sz % 7 + d) % 9) as Description from prt",
    "mig": "select distinct owner_id, d as seq, cast(sz % 5 as bigint) as row_ord, 'v' || (12 + sz % 5) as identifier from prt",
    "item": """select owner_id, d as seq, k as row_ord, k as PlaylistItemId, 'label ' || (k % 40) as Label, case when k % 3 = 0 then cast(10 as bigint) end as StartTrimOffsetTicks, cast(null as bigint) as EndTrimOffsetTicks,
        k % 97 + 1000 * d as Accuracy, k % 4 as EndAction, case when k % 5 = 0 then 'p' || (k % 9) || '.jpg' end as ThumbnailFilePath from ord""",
    "item_tag": "select owner_id, d as seq, k as row_ord, k as TagMapId, k as PlaylistItemId, cast(null as bigint) as LocationId, cast(null as bigint) as NoteId, k % 5 as TagId, k as Position from ord",
    "ptag": "select distinct owner_id, d as seq, k % 5 as row_ord, k % 5 as TagId, cast(2 as bigint) as Type, 'list ' || (k % 5) as Name from ord",
    "pmedia": "select distinct owner_id, d as seq, k % 9 as row_ord, k % 9 as IndependentMediaId, 'f' as OriginalFilename, 'p' || (k % 9) || '.jpg' as FilePath, 'm' as MimeType, 'h' || (k % 9) as Hash from ord",
    "pmm": "select owner_id, d as seq, k as row_ord, k as PlaylistItemId, k % 9 as IndependentMediaId, k % 2 as DurationTicks from ord where k % 3 <> 1",
    "plm": "select owner_id, d as seq, k as row_ord, k as PlaylistItemId, k % 6 as LocationId, k % 2 as MajorMultimediaType, cast(null as bigint) as BaseDurationTicks from ord where k % 2 = 0",
    "ploc": """select distinct owner_id, d as seq, k % 6 as row_ord, k % 6 as LocationId, cast(1 as bigint) as BookNumber, k % 6 as ChapterNumber, cast(null as bigint) as DocumentId, cast(null as bigint) as Track,
        cast(0 as bigint) as IssueTagNumber, 'sym' as KeySymbol, cast(294 as bigint) as MepsLanguage, cast(0 as bigint) as Type, 't' as Title, cast(null as string) as Specialty, cast(null as string) as Edition from ord""",
    "im": "select owner_id, d as seq, k as row_ord, c % 97 + 1000 * d as PlaylistItemId, k % 9 + 1000 * d as IndependentMediaId, k as DurationTicks from ord",
    "il": "select owner_id, d as seq, k as row_ord, c % 97 + 1000 * d as PlaylistItemId, k % 31 + 1000 * d as LocationId, k % 3 as MajorMultimediaType, cast(null as bigint) as BaseDurationTicks from ord",
    "mkr": """select e.user_id % 16 as owner_id, d as seq, min(event_id) as row_ord, min(event_id) as PlaylistItemMarkerId, user_id % 97 + 1000 * d as PlaylistItemId, min(event_type) as Label,
        event_id % 97 as StartTimeTicks, cast(5 as bigint) as DurationTicks, cast(0 as bigint) as EndTransitionDurationTicks from events e, dev where (event_id * 7 + d * 13) % 5 <> 0
        group by e.user_id % 16, d, user_id % 97 + 1000 * d, event_id % 97""",
    "vrs": "select user_id % 16 as owner_id, d as seq, event_id as row_ord, event_id % 97 + 1000 * d as PlaylistItemMarkerId, length(event_type) + event_id % 3 as VerseId from events, dev where (event_id * 7 + d * 13) % 5 <> 0",
    "par": "select user_id % 16 as owner_id, d as seq, event_id as row_ord, event_id % 97 + 1000 * d as PlaylistItemMarkerId, user_id % 9 as MepsDocumentId, event_id % 4 as ParagraphIndex, event_id % 2 as MarkerIndexWithinParagraph from events, dev where (event_id * 7 + d * 13) % 5 <> 0",
    "listing": "select user_id as owner_id, cast(cast(ts as date) as string) as poll, event_type as name, cast(floor(value) as bigint) % 4 as size, event_id % 2 as mtime from events",
    "polls": "select user_id as owner_id, event_id as poll, 'f' || (event_id % 3) as fingerprint, event_id % 7 <> 0 as merge_ok from events",
    "sight": "select user_id as owner_id, event_type as device, cast(cast(ts as date) as string) as last_modified, event_id as seen_at, event_id % 2 as half from events",
    "own": """select c_custkey as owner_id, c_name as name, c_custkey * 37 % 1000 as updated, case when c_custkey % 3 <> 0 then 'lib' || c_custkey end as library,
        case when c_custkey % 3 <> 0 then 'sum' || c_custkey end as summary from customer""",
}

#: A whole library: every reference holds inside its snapshot. A snapshot d has place p unless (p + d) % 6 = 0, and rows
#: that would hang on a place that is not there are left out. Ids differ by device, so every reference has to be mapped.
VIEWS |= {
    "own_dev": "select distinct owner_id, d from ord",
    # of p % 4: 0 has the book key, 1 the media key, 2 both, 3 none; some differ by device in what is no part of the key
    "w_place": """select owner_id, d as seq, p + 1 + 1000 * d as row_ord, p + 1 + 1000 * d as LocationId, p,
        case when p % 4 = 0 then p + 1 when p % 4 = 2 then 200 + p end as BookNumber, case when p % 4 = 0 then p % 7 when p % 4 = 2 then (case when d = 3 then 2 else 1 end) end as ChapterNumber,
        case when p % 4 = 1 then p when p % 4 = 2 then 500 + p when p % 4 = 3 then 900 + p end as DocumentId, case when p % 4 in (1, 2) then cast(1 as bigint) end as Track,
        case when p % 5 = 0 and p % 4 = 0 then 's' || (d % 2) end as Specialty from (select o.owner_id, o.d, q.p_partkey as p from own_dev o, part q where q.p_partkey < 60) x where (p + d) % 6 <> 0""",
    "w_loc": """select owner_id, seq, row_ord, LocationId, cast(BookNumber as bigint) as BookNumber, cast(ChapterNumber as bigint) as ChapterNumber, cast(DocumentId as bigint) as DocumentId, Track, cast(0 as bigint) as IssueTagNumber,
        'sym' || (p % 3) as KeySymbol, cast(294 as bigint) as MepsLanguage, cast(0 as bigint) as Type, 'place ' || p as Title, Specialty, cast(null as string) as Edition from w_place""",
    "w_mark": """select owner_id, d as seq, k + 1000000 * d as row_ord, k + 1000000 * d as UserMarkId, k % 6 as ColorIndex, c % 60 + 1 + 1000 * d as LocationId, cast(d as bigint) as StyleIndex, 'g' || k as UserMarkGuid,
        case when k % 10 = 0 and d > 0 then cast(0 as bigint) else 1 + (k * (d + 1)) % 4 end as Version, c % 60 as p from ord where k % 2 = 0 and (c % 60 + d) % 6 <> 0""",
    "w_rng": """select m.owner_id, m.seq, m.UserMarkId * 2 + i.d as row_ord, m.UserMarkId * 2 + i.d as BlockRangeId, cast(1 as bigint) as BlockType, cast(i.d + 1 as bigint) as Identifier, m.ColorIndex % 5 as StartToken,
        case when m.ColorIndex = 4 then cast(null as bigint) else m.ColorIndex % 5 + m.seq % 3 end as EndToken, m.UserMarkId from w_mark m, dev i where i.d < 2""",
    "w_note": """select owner_id, d as seq, k + 1000000 * d as row_ord, k + 1000000 * d as NoteId, 'n' || k as Guid, case when k % 2 = 0 then k + 1000000 * d when k % 5 = 0 then 0 end as UserMarkId, c % 60 + 1 + 1000 * d as LocationId,
        case when k % 50 = 0 then null else pri end as Title, case when (k + d) % 3 = 0 then 'edit' || d when k % 7 = 0 then '' when k % 7 = 1 then null else 'v0' end as Content,
        cast(dy + cast((k * d) % 3 as int) as string) || 'T00:00:00Z' as LastModified, cast(dy as string) || 'T00:00:00Z' as Created, cast(0 as bigint) as BlockType, cast(null as bigint) as BlockIdentifier from ord where k % 3 = 0 and (c % 60 + d) % 6 <> 0""",
    "w_bkm": """select owner_id, seq, row_ord, row_ord as BookmarkId, LocationId, PublicationLocationId, rk - 1 as Slot, 'b' || row_ord as Title, cast(null as string) as Snippet, cast(0 as bigint) as BlockType, cast(null as bigint) as BlockIdentifier from (
        select *, row_number() over (partition by owner_id, seq, PublicationLocationId order by row_ord) as rk from (
          select owner_id, d as seq, min(k) as row_ord, (k * 11) % 60 + 1 + 1000 * d as LocationId, c % 23 + 1 + 1000 * d as PublicationLocationId from ord where k % 3 = 0 and ((k * 11) % 60 + d) % 6 <> 0 and (c % 23 + d) % 6 <> 0
          group by owner_id, d, (k * 11) % 60, c % 23) b) e where rk <= 10""",
    "w_ans": """select owner_id, d as seq, min(k) as row_ord, c % 50 + 1 + 1000 * d as LocationId, pri as TextTag, 'a' || (min(k) % 5) || case when (min(k) + d) % 3 = 0 then '-' || d else '' end as Value
        from ord where (c % 50 + d) % 6 <> 0 group by owner_id, d, c % 50, pri""",
    "w_tag": """select owner_id, d as seq, t + 1 + 100 * d as row_ord, t + 1 + 100 * d as TagId, case when t = 0 then cast(0 as bigint) when t < 6 then cast(1 as bigint) else cast(2 as bigint) end as Type, case when t = 0 then 'Favorite' else 'tag ' || (t + case when t % 3 = 2 then d else 0 end) end as Name
        from (select o.owner_id, o.d, q.p_partkey as t from own_dev o, part q where q.p_partkey < 10) x""",
    "w_media": """select distinct owner_id, d as seq, k % 9 + 1 + 50 * d as row_ord, k % 9 + 1 + 50 * d as IndependentMediaId, 'f' || (k % 9) as OriginalFilename, 'p' || (k % 9) || case when k % 9 = 4 then '-' || d else '' end || '.jpg' as FilePath,
        'image/jpeg' as MimeType, 'h' || (k % 9) || case when k % 9 = 5 then '-' || (d % 2) else '' end as Hash from ord""",
    "w_member": "select owner_id, seq, FilePath as member from w_media where not (seq = 2 and IndependentMediaId % 50 = 4)",
    "w_acc": "select distinct owner_id, d as seq, k % 4 + 1 + 10 * d as row_ord, k % 4 + 1 + 10 * d as PlaylistItemAccuracyId, 'accuracy ' || (k % 4) as Description from ord",
    "w_item": """select owner_id, d as seq, k + 1000000 * d as row_ord, k + 1000000 * d as PlaylistItemId, 'label ' || (k % 40) as Label, case when k % 3 = 0 then cast(10 as bigint) end as StartTrimOffsetTicks, cast(null as bigint) as EndTrimOffsetTicks,
        k % 4 + 1 + 10 * d as Accuracy, k % 4 as EndAction, case when k % 10 = 0 then 'p' || (k % 9) || case when k % 9 = 4 then '-' || d else '' end || '.jpg' end as ThumbnailFilePath, c % 60 as p from ord where k % 5 = 0 and (c % 60 + d) % 6 <> 0""",
    "w_pmm": "select owner_id, seq, row_ord, PlaylistItemId, (PlaylistItemId - 1000000 * seq) % 9 + 1 + 50 * seq as IndependentMediaId, PlaylistItemId % 2 as DurationTicks from w_item",
    "w_plm": "select owner_id, seq, row_ord, PlaylistItemId, p + 1 + 1000 * seq as LocationId, cast(1 as bigint) as MajorMultimediaType, cast(null as bigint) as BaseDurationTicks from w_item where PlaylistItemId % 2 = 0",
    "w_mkr": "select owner_id, seq, row_ord, PlaylistItemId as PlaylistItemMarkerId, PlaylistItemId, 'marker' as Label, PlaylistItemId % 7 as StartTimeTicks, cast(5 as bigint) as DurationTicks, cast(0 as bigint) as EndTransitionDurationTicks from w_item where PlaylistItemId % 3 = 0",
    "w_vrs": "select owner_id, seq, row_ord, PlaylistItemMarkerId, PlaylistItemMarkerId % 31 as VerseId from w_mkr",
    "w_par": "select owner_id, seq, row_ord, PlaylistItemMarkerId, PlaylistItemMarkerId % 9 as MepsDocumentId, PlaylistItemMarkerId % 4 as ParagraphIndex, cast(0 as bigint) as MarkerIndexWithinParagraph from w_mkr",
    "w_tagmap": """select owner_id, seq, k as row_ord, k as TagMapId, PlaylistItemId, LocationId, NoteId, TagId, row_number() over (partition by owner_id, seq, TagId order by k) - 1 as Position from (
        select owner_id, seq, PlaylistItemId * 4 as k, PlaylistItemId, cast(null as bigint) as LocationId, cast(null as bigint) as NoteId, 7 + PlaylistItemId % 4 + 100 * seq as TagId from w_item
        union all select owner_id, seq, NoteId * 4 + 1, null, null, NoteId, 2 + NoteId % 5 + 100 * seq from w_note
        union all select owner_id, seq, LocationId * 4 + 2, null, LocationId, null, 1 + 100 * seq from w_place where p % 2 = 1) x""",
    "w_mig": "select owner_id, d as seq, cast(14 + i as bigint) as row_ord, 'v' || (14 + i) as identifier from (select o.owner_id, o.d, e.d as i from own_dev o, dev e where e.d <= o.d) x",
    "w_mod": "select owner_id, d as seq, cast(1 as bigint) as row_ord, '2025-01-0' || (1 + d) || 'T00:00:00Z' as LastModified from own_dev",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def needed(names: tuple[str, ...], text: str = "") -> list[str]:
    """Views that text and the named views use, parents first."""
    import re

    used: set[str] = set()

    def visit(sql: str) -> None:
        for v in VIEWS:
            if v not in used and re.search(rf"\b(from|join|,)\s+{v}\b", sql):
                used.add(v)
                visit(VIEWS[v])

    for n in names:
        used.add(n)
        visit(VIEWS[n])
    visit(text)
    return [v for v in VIEWS if v in used]


def with_views(text: str, engine: str = "duckdb") -> str:
    """text behind a WITH clause of the views that it uses."""
    sha = (lambda s: s.replace("sha256(text)", "sha2(text, 256)")) if engine == "spark" else (lambda s: s)
    # integer division differs between the engines
    div = (lambda s: s.replace("(doc_id / 8)", "(doc_id div 8)")) if engine == "spark" else (lambda s: s.replace("(doc_id / 8)", "(doc_id // 8)"))
    # DuckDB works a view out anew for each use unless told otherwise
    once = "materialized " if engine == "duckdb" else ""
    views = ",\n".join(f"{v} as {once}({div(sha(VIEWS[v]))})" for v in needed((), text))
    body = text.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {views},\n{body[15:]}" if views else body
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}" if views else body
    return f"with {views}\n{body}" if views else body


class Views:
    """The projections over the tables of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def sql(self, text: str) -> DataFrame:
        import re

        full = with_views(text, "spark")
        used = [t for t in TABLES if re.search(rf"\b{t}\b", full)]
        for t in used:
            full = re.sub(rf"\b(from|join|,)(\s+){t}\b", rf"\1\2{{{t}}}", full)
        return self.spark.sql(full, **{t: self.spark.read.parquet(f"{self.dir}/{t}.parquet") for t in used if f"{{{t}}}" in full})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"select * from {name}")

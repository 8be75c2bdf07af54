"""Counts and reports over tables, decisions, conflicts and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ["added", "updated", "reused", "skipped"]


def table_counts(tables: dict[str, DataFrame], *keys: str) -> DataFrame:
    """keys, table, n for each table."""
    by = keys or ("owner_id",)
    return reduce(DataFrame.unionByName, (df.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(t).alias("table"), "n") for t, df in tables.items()))


def action_counts(decisions: DataFrame) -> DataFrame:
    """A column for each action, by owner, snapshot and table."""
    return decisions.groupBy("owner_id", "seq", "table").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ACTIONS))


def totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """owner_id, table, before, after, difference of two count tables."""
    a, b = before.withColumnRenamed("n", "before"), after.withColumnRenamed("n", "after")
    both = a.join(b, ["owner_id", "table"], "full").fillna(0, ["before", "after"])
    return both.withColumn("difference", F.col("after") - F.col("before"))


def media_counts(decisions: DataFrame, renames: DataFrame) -> DataFrame:
    """Media added (with a file), reused and renamed, by owner and snapshot."""
    mine = decisions.filter(F.col("table").isin("IndependentMedia", "IndependentMediaFile"))
    counts = mine.groupBy("owner_id", "seq").agg((F.count_if(F.col("action") == "added") - F.count_if(F.col("action") == "skipped")).alias("media_added"), F.count_if(F.col("action") == "reused").alias("media_reused"))
    n = renames.groupBy("owner_id", "seq").agg(F.count("*").alias("media_renamed"))
    return counts.join(n, ["owner_id", "seq"], "left").fillna(0, ["media_renamed"])


def conflict_list(*conflicts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, conflicts)


def summary(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """owner_id, new_rows and a verdict line."""
    new = decisions.filter("action = 'added'").groupBy("owner_id").agg(F.count("*").alias("new_rows"))
    return verdicts.join(new, "owner_id", "left").select("owner_id", F.coalesce("new_rows", F.lit(0)).alias("new_rows"), F.when(F.col("ok"), "verified").otherwise("CHECK FAILED").alias("verdict"))


#: Tables whose rows a person would name.
NAMED = ("Note", "UserMark", "Bookmark", "InputField", "Tag", "PlaylistItem", "IndependentMedia")


def digest(decisions: DataFrame) -> DataFrame:
    """New or changed rows of the named tables for each snapshot."""
    mine = decisions.filter(F.col("table").isin(*NAMED) & F.col("action").isin("added", "updated"))
    return mine.groupBy("owner_id", "seq").agg(F.count("*").alias("changed"))


def device_counts(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct devices of each owner over stored and new snapshots; a snapshot without device counts by its file."""
    names = stored.select("owner_id", "name").union(found.select("owner_id", F.coalesce(F.nullif(F.col("device"), F.lit("")), F.col("file"))))
    return names.groupBy("owner_id").agg(F.countDistinct("name").alias("devices"))


def stored_summary(counts: DataFrame) -> DataFrame:
    """One map of table to number of rows for each owner."""
    return counts.groupBy("owner_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n")))).alias("summary"))


def report_json(action_counts: DataFrame, conflicts: DataFrame, totals: DataFrame, limit: int = 1000) -> DataFrame:
    """owner_id, part and a JSON report, for every owner with counters, conflicts or totals.

    Part 0 has sources with counters, totals, the number of conflicts and the first `limit` of them; each further part
    has the next `limit`, so all conflicts are reported and no row is unbounded.
    """
    from pyspark.sql import Window as W

    per = action_counts.groupBy("owner_id", "seq").agg(F.array_sort(F.collect_list(F.struct("table", *ACTIONS))).alias("tables"))
    sources = per.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("seq", "tables"))).alias("sources"))
    sums = totals.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("table", "before", "after"))).alias("totals"))
    ranked = conflicts.withColumn("_n", F.row_number().over(W.partitionBy("owner_id").orderBy("seq", "table", "detail", "resolution")) - 1)
    parts = ranked.groupBy("owner_id", F.floor(F.col("_n") / limit).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "table", "detail", "resolution"))).alias("conflicts"))
    full = conflicts.groupBy("owner_id").agg(F.count("*").alias("n_conflicts"))
    owners = reduce(DataFrame.union, (df.select("owner_id") for df in (sources, sums, full))).distinct()
    first = owners.join(sums, "owner_id", "left").join(sources, "owner_id", "left").join(full, "owner_id", "left").join(parts.filter("part = 0").drop("part"), "owner_id", "left")
    head = first.select("owner_id", F.lit(0).alias("part"), F.to_json(F.struct("sources", "totals", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), "conflicts")).alias("report"))
    return head.union(parts.filter("part > 0").select("owner_id", "part", F.to_json(F.struct("conflicts")).alias("report")))


def report_text(action_counts: DataFrame, totals: DataFrame) -> DataFrame:
    """owner_id, line_ord, line: a plain text report."""
    head = action_counts.select("owner_id", F.concat_ws("|", F.lit("1"), F.col("seq").cast("string"), "table").alias("line_ord"), F.format_string("source %d, %s: %d added, %d updated, %d reused, %d skipped", "seq", "table", *ACTIONS).alias("line"))
    tail = totals.select("owner_id", F.concat_ws("|", F.lit("2"), "table").alias("line_ord"), F.format_string("%s: %d -> %d (%+d)", "table", "before", "after", "difference").alias("line"))
    return head.union(tail)

"""Conflict rules: all snapshots of an owner at once, in the order (seq, row_ord) in which a one-by-one fold meets them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.shared import cut

ORDER = ("seq", "row_ord")


@dataclass(frozen=True)
class Layout:
    """How a step's result that several others use is held: not at all, or written once; and whether all rows of an owner
    are together, so that grouping and joining by owner and more moves nothing."""

    hold: Callable[[DataFrame], DataFrame]
    together: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.hold(df)


AS_IS = Layout(lambda df: df)


def window(*keys: str | Column, order: tuple = ORDER):
    return W.partitionBy("owner_id", *keys).orderBy(*order)


def first_wins(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Adds action: base for all rows of the base, added for the first row of a key, reused for later ones; and lead, the
    (seq, row_ord) of the row that stands for the key."""
    w = window(*keys)
    action = F.when(F.col("seq") == 0, "base").when(F.row_number().over(w) == 1, "added").otherwise("reused")
    return rows.withColumn("action", action).withColumn("lead", F.first(F.struct(*ORDER)).over(w))


def last_wins(rows: DataFrame, value: str, *keys: str | Column) -> DataFrame:
    """Adds action: added, updated where the value differs from the one before, else reused; and final on the last row."""
    w = window(*keys)
    before, n = F.lag(value).over(w), F.row_number().over(w)
    size = F.count("*").over(W.partitionBy("owner_id", *keys))
    action = F.when(F.col("seq") == 0, "base").when(n == 1, "added").when(F.col(value).eqNullSafe(before), "reused").otherwise("updated")
    return rows.withColumn("action", action).withColumn("final", n == size)


def highest_version(rows: DataFrame, version: str, *keys: str | Column) -> DataFrame:
    """Adds action (a strictly higher version than all before updates), epoch (updates so far) and final."""
    w = window(*keys)
    v = F.coalesce(F.col(version), F.lit(0))
    before = F.max(v).over(w.rowsBetween(W.unboundedPreceding, -1))
    action = F.when(F.col("seq") == 0, "base").when(before.isNull(), "added").when(v > before, "updated").otherwise("reused")
    out = rows.withColumn("action", action)
    out = out.withColumn("epoch", F.sum((F.col("action") == "updated").cast("int")).over(w))
    last = F.max("epoch").over(W.partitionBy("owner_id", *keys))
    first = F.row_number().over(W.partitionBy("owner_id", *keys, "epoch").orderBy(*ORDER)) == 1
    return out.withColumn("final", (F.col("epoch") == last) & first)


def fold_newest(rows: DataFrame, stamp: str, text: Column, *keys: str, ident: str | None = None, created: str | None = None) -> DataFrame:
    """Fold of edited texts: a row replaces the current one if its stamp is later and its text differs.

    A later copy with the same text does not move the current stamp, so this is a fold and no maximum. Returns a row for
    each key with seq, row_ord and stamp (whose content is final), decisions (array of seq, row_ord, action, tie, stamp and id,
    from `ident`), in order, and the first row's created. Texts are compared by digest; arrays hold one small entry for each
    snapshot of a key.
    """
    number = F.col(ident) if ident else F.lit(None)
    entry = F.struct(*ORDER, F.coalesce(stamp, F.lit("")).alias("stamp"), text.alias("digest"), number.cast("long").alias("id"))
    first = F.min_by(created or F.lit(None).cast("string"), F.struct(*ORDER)).alias("created")
    grouped = rows.groupBy("owner_id", *keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"), first)
    one = "struct<seq:int,row_ord:bigint,action:string,tie:boolean,stamp:string,id:bigint>"
    kind = f"struct<seq:int,row_ord:bigint,stamp:string,digest:{dict(rows.select(text.alias('t')).dtypes)['t']},decisions:array<{one}>>"
    head = F.col("entries")[0]

    def decision(e: Column, action: Column, tie: Column) -> Column:
        return F.array(F.struct(e["seq"], e["row_ord"], action.alias("action"), tie.alias("tie"), e["stamp"], e["id"]))

    start = F.struct(head["seq"].alias("seq"), head["row_ord"].alias("row_ord"), head["stamp"].alias("stamp"), head["digest"].alias("digest"), decision(head, F.when(head["seq"] == 0, "base").otherwise("added"), F.lit(False)).alias("decisions")).cast(kind)

    def step(state: Column, e: Column) -> Column:
        same = state["digest"] == e["digest"]
        take = ~same & (e["stamp"] > state["stamp"])
        tie = ~same & (e["stamp"] == state["stamp"])
        pick = lambda name: F.when(take, e[name]).otherwise(state[name]).alias(name)
        more = decision(e, F.when(take, "updated").otherwise("reused"), tie)
        return F.struct(pick("seq"), pick("row_ord"), pick("stamp"), pick("digest"), F.concat(state["decisions"], more).alias("decisions")).cast(kind)

    folded = F.aggregate(F.slice("entries", 2, F.greatest(F.lit(1), F.size("entries"))), start, step)
    out = grouped.withColumn("_s", folded)
    return out.select("owner_id", *keys, F.col("_s.seq").alias("seq"), F.col("_s.row_ord").alias("row_ord"), F.col("_s.stamp").alias("stamp"), F.col("_s.decisions").alias("decisions"), "created")


def first_free_slot(rows: DataFrame, group: str, slot: str, *keys: str | Column, slots: int = 10) -> DataFrame:
    """New keys take the free slots of their group in order; action: base, added, reused or, past the slots, skipped.

    Base rows carry their slots. A repeat of a key is reused if the first of it got a slot, else skipped.
    """
    w = window(group, *keys)
    marked = rows.withColumn("_first", F.row_number().over(w) == 1).withColumn("_base", F.first("seq").over(w) == 0)
    new = marked.filter("_first and not _base")
    used = rows.filter("seq = 0").groupBy("owner_id", group).agg(F.collect_set(F.col(slot).cast("long")).alias("_used"))
    none = F.array().cast("array<bigint>")
    free = F.array_sort(F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")), F.coalesce("_used", none)))
    ranked = new.withColumn("_rank", F.row_number().over(window(group))).filter(F.col("_rank") <= slots)
    given = ranked.join(used, ["owner_id", group], "left").withColumn("_slot", F.try_element_at(free, F.col("_rank")))
    given = given.select("owner_id", *ORDER, "_slot")
    out = marked.join(given, ["owner_id", *ORDER], "left")
    got = F.first("_slot").over(w)
    action = F.when(F.col("seq") == 0, "base").when(F.col("_base"), "reused").when(got.isNull(), "skipped").when(F.col("_first"), "added").otherwise("reused")
    final = F.when(F.col("seq") == 0, F.col(slot).cast("long")).when(F.col("_first") & ~F.col("_base"), F.col("_slot"))
    return out.withColumn("action", action).withColumn("final_slot", final).drop("_first", "_base", "_slot")


def append_position(rows: DataFrame, group: str, position: str, order: tuple, *keys: str | Column, layout: Layout = AS_IS) -> DataFrame:
    """New keys go behind the highest position of their group's base rows, in the given order; others are reused."""
    w = window(group, *keys, order=("seq", *order))
    action = F.when(F.col("seq") == 0, "base").when(F.row_number().over(w) == 1, "added").otherwise("reused")
    marked = rows.withColumn("action", action)
    if layout.together:
        top = F.max(F.when(F.col("seq") == 0, F.col(position))).over(W.partitionBy("owner_id", group))
        nth = F.row_number().over(window(group, F.col("action") == "added", order=("seq", *order)))
        return marked.withColumn("final_position", F.when(F.col("action") == "base", F.col(position)).when(F.col("action") == "added", F.coalesce(top, F.lit(-1)) + nth).cast("long"))
    top = rows.filter("seq = 0").groupBy("owner_id", group).agg(F.max(position).alias("_top"))
    numbered = number_rows(marked.filter("action = 'added'"), ["owner_id", group], ["seq", *order], layout)
    numbered = numbered.join(top, ["owner_id", group], "left").withColumn("final_position", F.coalesce("_top", F.lit(-1)) + F.col("number")).drop("_top", "number")
    return numbered.unionByName(marked.filter("action <> 'added'").withColumn("final_position", F.when(F.col("action") == "base", F.col(position)).cast("long")))


def number_rows(rows: DataFrame, groups: list[str], order: list[str], layout: Layout = AS_IS, also: dict[str, tuple[Column, Callable]] | None = None) -> DataFrame:
    """number: 1, 2, ... within each group by `order`.

    Where an owner's rows are together they are sorted and numbered in place. Else rows are dealt to ranges of (group, order)
    that hold about equally many, whatever the values, and are sorted there; the rows of a group in the ranges before are
    counted, and added to the place inside the range. So a group of any size is spread, and no task sums over more than a
    row for each range. also: columns with what holds for a group, as name: (aggregate of rows, function that unites those).
    """
    also = also or {}
    whole = W.partitionBy(*groups)
    if layout.together:
        return rows.withColumns({"number": F.row_number().over(whole.orderBy(*order)).cast("long")} | {n: one.over(whole) for n, (one, _) in also.items()})
    if layout is AS_IS:
        # else all that rows comes from is worked out twice, once for a sample, and its shuffles stay beside those made here
        rows = cut(rows, "to-number")
    by = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy(*groups, "_range").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"), *(one.alias(n) for n, (one, _) in also.items()))
    before = F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")
    # written, so that Spark knows how few they mostly are and sends them to the rows
    runs = cut(runs.select(*groups, "_range", (before - F.col("_low") + 1).alias("_shift"), *(both(n).over(whole).alias(n) for n, (_, both) in also.items())), "runs")
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*groups, "_range"]]
    return placed.alias("a").join(runs.alias("b"), cond).select(*(f"a.{c}" for c in rows.columns), (F.col("a._at") + F.col("b._shift")).alias("number"), *(f"b.{n}" for n in also))


def with_new_ids(rows: DataFrame, id_column: str, layout: Layout = AS_IS) -> DataFrame:
    """target_id: its own for base rows; added rows continue behind the owner's highest base id, in order."""
    if layout.together:
        top = F.max(F.when(F.col("seq") == 0, F.col(id_column))).over(W.partitionBy("owner_id"))
        nth = F.row_number().over(window(F.col("action") == "added"))
        own = F.when(F.col("action") == "base", F.col(id_column)).otherwise(F.coalesce(top, F.lit(0)) + nth)
        return rows.filter("action in ('base', 'added')").withColumn("target_id", own)
    base = F.col("seq") == 0
    # base rows come first in their owner's order, so all are numbered in one go and rows is worked out once
    also = {"_top": (F.max(F.when(base, F.col(id_column))), F.max), "_base": (F.count_if(base), F.sum)}
    numbered = number_rows(rows.filter("action in ('base', 'added')"), ["owner_id"], ["seq", "row_ord"], layout, also)
    own = F.when(base, F.col(id_column)).otherwise(F.coalesce("_top", F.lit(0)) + F.col("number") - F.col("_base"))
    return numbered.withColumn("target_id", own).drop("_top", "_base", "number")


def id_map(rows: DataFrame, numbered: DataFrame, id_column: str) -> DataFrame:
    """owner_id, seq, src_id, target_id of every row, by the row that stands for it (lead)."""
    lead = numbered.select("owner_id", F.col("seq").alias("_s"), F.col("row_ord").alias("_r"), "target_id")
    own = rows.select("owner_id", "seq", F.col(id_column).alias("src_id"), F.when(F.col("action") == "base", F.struct("seq", "row_ord")).otherwise(F.col("lead")).alias("lead"))
    return own.join(lead, (own["owner_id"] == lead["owner_id"]) & (F.col("lead.seq") == F.col("_s")) & (F.col("lead.row_ord") == F.col("_r"))).select(own["owner_id"], "seq", "src_id", "target_id")


def remap(rows: DataFrame, column: str, mapping: DataFrame, to: str, zero_is_null: bool = False, base: bool = False) -> DataFrame:
    """Adds `to`: the target id of rows.column by (owner, snapshot), null where there is none; with `base`, rows of the base
    keep their own."""
    m = mapping.select(F.col("owner_id").alias("_o"), F.col("seq").alias("_q"), F.col("src_id").alias("_i"), F.col("target_id").alias("_t"))
    ref = F.nullif(F.col(column), F.lit(0)) if zero_is_null else F.col(column)
    found = F.when(F.col("seq") == 0, F.col(column)).otherwise(F.col("_t")) if base else F.col("_t")
    return rows.join(m, (F.col("owner_id") == F.col("_o")) & (F.col("seq") == F.col("_q")) & (ref == F.col("_i")), "left").withColumn(to, found).drop("_o", "_q", "_i", "_t")

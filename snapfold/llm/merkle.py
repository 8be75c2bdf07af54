"""Merkle manifest of a table of documents: a tree over each source's rows, and one over the sources' roots.

A leaf is the SHA-256, as lower-case hex, of a row's fields; ARITY consecutive nodes become the digest of their joined hex.
Nodes are numbered within their source and dealt to aligned blocks of ARITY ** depth. A block keeps each level as one
string of hex digits: fixed-width substrings of it are hashed to the level above, and the digits on both sides of a
node in its run are its siblings. The roots of the blocks are the nodes of the next round, until a source has one; the
sources' roots go through the same rounds. On the way back each block hands the siblings above it to the blocks below, so
a row's proof is read where its block is, and rows are not joined to nodes.

Only digests are shuffled, never texts, and no task holds more than a block: numbering takes ranges of (source, doc_id)
and counts of each range, so a source of any size is spread.

Edge cases: a null field is `-`, an empty one `0:`; null ids come first, and so does the null source; rows with equal ids
are ordered by their digest, so the result does not depend on which of two equal rows comes first; a source of one row has its
leaf as root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.llm.common import cut

ARITY, HEX = 3, 64
RUN = ARITY * HEX
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes below one node of each level; more levels than 63-bit positions need.
POWERS = [ARITY**k for k in range(40)]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def leaf(**changed: Column) -> Column:
    """The digest of a row's FIELDS, of which some may be changed."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values))


def levels_above(total: Column) -> Column:
    """How often nodes become their parents until one of `total` is left."""
    return F.size(F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < total))


def same(one: str, two: str, keys: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"{one}.{k}").eqNullSafe(F.col(f"{two}.{k}")) for k in keys))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with pos (0, 1, ... in each group of equal keys, by `order`) and total (the size of the group).

    Rows are dealt to ranges and sorted there; a range's rows of a group follow those of the ranges before it.
    """
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("range", F.shiftright("at", 33))
    runs = placed.groupBy(*keys, "range").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    group = W.partitionBy(*keys)
    before = F.sum("n").over(group.orderBy("range")) - F.col("n")
    runs = runs.select(*keys, "range", (before - F.col("lo")).alias("shift"), F.sum("n").over(group).alias("total"))
    joined = placed.alias("a").join(runs.alias("b"), same("a", "b", [*keys, "range"]))
    return joined.select(*(f"a.{c}" for c in rows.columns), (F.col("a.at") + F.col("b.shift")).alias("pos"), "b.total")


def parents(level: Column) -> Column:
    """The level above a level, both as bytes of hex digits."""
    starts = F.sequence(F.lit(1), F.octet_length(level), F.lit(RUN))
    return F.array_join(F.transform(starts, lambda at: F.sha2(F.substr(level, at, F.lit(RUN)), 256)), "").cast("binary")


def blocks(nodes: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """keys, total, block, items (in order), levels and steps of aligned blocks of nodes (keys, total, pos, node: bytes, ...).

    steps is the number of levels above the block's own nodes that the block works out.
    """
    rest = [c for c in nodes.columns if c not in (*keys, "total", "pos")]
    placed = nodes.withColumn("block", ((F.col("pos") - F.col("pos") % POWERS[depth]) / POWERS[depth]).cast("long"))
    made = placed.groupBy(*keys, "total", "block").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("items"))
    made = made.withColumn("steps", F.least(F.lit(depth), levels_above(F.col("total"))))
    own = F.array_join(F.transform("items", lambda x: F.lower(F.hex(x["node"]))), "").cast("binary")
    above = F.aggregate(F.slice(F.array(*map(F.lit, POWERS)), F.lit(1), F.col("steps")), F.array(own).cast("array<binary>"), lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1)))).cast("array<binary>"))
    return cut(made.withColumn("levels", above), "merkle-blocks")


def siblings(levels: Column, steps: Column, nth: Column) -> Column:
    """Of the block's nth node: what stands to its left and right in its run, and so on upwards."""

    def step(power: Column, k: Column) -> Column:
        node = F.floor(nth / power)
        start, before = F.floor(node / ARITY) * RUN + 1, (node % ARITY) * HEX
        level = F.get(levels, k)
        part = lambda at, size: F.substr(level, at.cast("int"), size.cast("int"))
        return F.struct(part(start, before).alias("left"), part(start + before + HEX, F.lit(RUN - HEX) - before).alias("right"))

    return F.transform(F.slice(F.array(*map(F.lit, POWERS)), F.lit(1), steps), step)


def rounds(nodes: DataFrame, keys: list[str], depth: int) -> list[DataFrame]:
    """The blocks of each round; in the last one each group of equal keys has one block."""
    out, most = [], nodes.agg(F.max("total")).first()[0] or 0
    while True:
        out.append(blocks(nodes, keys, depth))
        if most <= POWERS[depth]:
            return out
        most = -(-most // POWERS[depth])
        top = F.unhex(F.element_at("levels", -1).cast("string"))
        nodes = out[-1].select(*keys, F.ceil(F.col("total") / POWERS[depth]).alias("total"), F.col("block").alias("pos"), top.alias("node"))


def roots(made: list[DataFrame]) -> DataFrame:
    """The last blocks with `top`, the hex of the root."""
    return made[-1].withColumn("top", F.element_at("levels", -1).cast("string"))


def handed_down(above: DataFrame, made: list[DataFrame], keys: list[str], more: list[str]) -> DataFrame:
    """The lowest blocks with `above`, all siblings above them, and the columns `more`.

    above: keys, above (the siblings of the root of each group) and `more`.
    """
    own = made[-1].alias("a").join(above.alias("b"), same("a", "b", keys)).select("a.*", "b.above", *(f"b.{c}" for c in more))
    for lower in made[-2::-1]:
        each = F.transform("items", lambda x, i: F.struct(x["pos"].alias("block"), F.concat(siblings(F.col("levels"), F.col("steps"), i), F.col("above")).alias("above")))
        rows = own.select(*keys, *more, F.inline(each))
        own = lower.alias("a").join(rows.alias("b"), same("a", "b", [*keys, "block"])).select("a.*", "b.above", *(f"b.{c}" for c in more))
    return own


def manifest(docs: DataFrame, depth: int = 6) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; blocks hold ARITY ** depth nodes.

    Rows whose CRC-32 of the decimal id is even are folded from a leaf whose text has lost its line feeds.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    joined = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    forged = F.when(tampered & F.contains("text", F.lit("\n")), F.unhex(leaf(text=joined)))
    nodes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.unhex(leaf()).alias("node"), forged.alias("forged")), "leaves")
    made = rounds(numbered(nodes, ["source"], ["doc_id", "node"]), ["source"], depth)
    tops = roots(made).select(F.lit(0).alias("all"), "source", F.col("top").alias("subroot"), F.unhex("top").alias("node"))
    over = rounds(numbered(tops, ["all"], ["source"]), ["all"], depth)
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    whole = handed_down(roots(over).select("all", none.alias("above"), F.col("top").alias("root")), over, ["all"], ["root"])
    each = F.transform("items", lambda x, i: F.struct(x["source"].alias("source"), x["subroot"].alias("subroot"), F.concat(siblings(F.col("levels"), F.col("steps"), i), F.col("above")).alias("above")))
    own = handed_down(whole.select("root", F.inline(each)), made, ["source"], ["root", "subroot"])

    path = F.transform("items", lambda x, i: F.struct(x["doc_id"].alias("doc_id"), x["node"].alias("node"), F.coalesce(x["forged"], x["node"]).alias("shown"), F.concat(siblings(F.col("levels"), F.col("steps"), i), F.col("above")).alias("path")))
    proof = lambda x: F.sha2(F.array_join(F.transform(x["path"], lambda s: F.concat(s["left"], s["right"]).cast("string")), ""), 256)
    fold = lambda x: F.aggregate(x["path"], F.lower(F.hex(x["shown"])), lambda now, s: digest(s["left"], now, s["right"]))
    rows = own.select("subroot", "root", F.inline(F.transform(path, lambda x: F.struct(x["doc_id"].alias("doc_id"), F.lower(F.hex(x["node"])).alias("leaf"), proof(x).alias("proof_sha256"), fold(x).alias("folded_root")))))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

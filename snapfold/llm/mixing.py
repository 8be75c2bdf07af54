"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words. A document is taken floor(target / size of source) times for certain, and
once more with the fractional rest as its inclusion probability. The cube method turns those probabilities into 0 or 1:
a flight phase moves them inside the null space of two balance equations (documents taken, words taken), in small blocks
spread over the cluster; the few undecided rows that each block leaves (a reserve of all sizes among them) meet in the
next round, until one block for each source is left, whose last rows (14 at most) are landed by trying their subsets.

Edge cases: a null or blank text has size 0 and is taken 0 words; a null source is a source of its own, last in
order; rows may repeat and are decided row by row; an empty table gives an empty result; other columns are ignored.
Reruns give the same rows, since every draw is seeded by its block and rows are sorted before they are used.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import WORD, cut, free_names

EPS = 1e-9
STATE = "row long, doc_id long, source string, size long, source_size long, target double, whole long, block long, p double"


def targets_by_weight(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """share * total dealt by weight; what exceeds cap * size is dealt again among the others."""
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in sorted(free) if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            rest -= out[i]
            free.discard(i)
    return out


def _move(p: list[float], u: list[float], rng) -> None:
    """One step of the martingale along u: up or down to the first bound, with the mean unchanged."""
    up = min(((1 - x) / v if v > 0 else x / -v) for x, v in zip(p, u) if v)
    down = min((x / v if v > 0 else (1 - x) / -v) for x, v in zip(p, u) if v)
    step = up if rng.random() * (up + down) < down else -down
    for i, v in enumerate(u):
        x = p[i] + step * v
        p[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x


def flight(p: np.ndarray, size: np.ndarray, rng, reserve: int) -> np.ndarray:
    """Round the probabilities p, keeping sum(p) and sum(p * size) and the mean of each.

    About `reserve` rows, of all sizes, are not touched, and at most two others stay fractional.
    """
    p = p.astype(float).copy()
    open_rows = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(open_rows) <= reserve + 2:
        return p
    held = np.unique(np.linspace(0, len(open_rows) - 1, reserve).round().astype(int))
    queue = np.delete(open_rows, held)[::-1].tolist()
    pool: list[int] = []
    while True:
        while queue and len(pool) < 3:
            pool.append(queue.pop())
        s = [float(size[i]) for i in pool]
        if len(pool) == 3:
            u = [s[2] - s[1], s[0] - s[2], s[1] - s[0]]
            u = u if any(u) else [1.0, -1.0, 0.0]
        elif len(pool) == 2 and s[0] == s[1]:
            u = [1.0, -1.0]
        else:
            return p
        top = max(map(abs, u))
        local = [p[i] for i in pool]
        _move(local, [x / top for x in u], rng)
        for i, x in zip(pool, local):
            p[i] = x
        pool = [i for i, x in zip(pool, local) if 0.0 < x < 1.0]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few rows left: of all their subsets, the one whose words and documents come nearest to the targets."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        s, q = size[left].astype(float), p[left]
        subsets = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
        off = np.abs(subsets @ s - q @ s) / max(1.0, s.mean()) + 0.1 * np.abs(subsets.sum(axis=1) - q.sum())
        p = p.copy()
        p[left] = subsets[off.argmin()]
    return p


def _round(seed: int, level: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        size, p = rows["size"].to_numpy(), rows["p"].to_numpy()
        # large rows first, so that many rows are left to even them out; equal rows stand for each other
        order = np.lexsort((rows["row"].to_numpy(), p, rows["doc_id"].fill_null(-(1 << 63)).to_numpy(), -size))
        name = key[0].as_py()
        rng = np.random.default_rng([seed, level, zlib.crc32(b"\0" if name is None else b"s" + name.encode()), key[1].as_py()])
        moved = flight(p[order], size[order], rng, 12 if last else 6)
        moved = land(moved, size[order]) if last else moved
        return rows.take(order).set_column(rows.schema.get_field_index("p"), "p", pa.array(moved))

    return run


def sizes_of(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row (a number of its own: the column of that name, else its place in the table), doc_id, source and size of every row."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """rows dealt to `blocks` blocks of their source by id and size; where more than block_rows rows share both, by row too."""
    alike = ("source", "doc_id", "size")
    many = rows.groupBy(*alike).count().filter(F.col("count") > block_rows).select(*(F.col(c).alias(f"_{c}") for c in alike), F.lit(True).alias("_many"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]
    salt = F.when(F.col("_many"), F.col("row")).otherwise(0)
    return rows.join(many, same, "left").withColumn("block", F.pmod(F.xxhash64("doc_id", "size", salt), F.col("blocks")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42, block_rows: int = 1024, fan_in: int = 256, max_sources: int = 1_000_000, row: str | None = None) -> DataFrame:
    """Decide how often each row of docs (doc_id, source, text) is taken.

    Returns row, doc_id, source, size, source_size, target, copies and taken = size * copies; `row` names a column of docs
    with a number for each row, if it has one. Sources are in code point order, null last, and get `weights` in turn. The
    table of sources (not of rows) passes the driver and is checked against max_sources.
    """
    spark = docs.sparkSession
    sizes = cut(sizes_of(docs, row), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets_by_weight([r["source_size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, cap)
    plan = []
    for r, target in zip(totals, goal):
        ratio = target / r["source_size"] if r["source_size"] else 0.0
        whole = math.floor(ratio + EPS)
        rest = ratio - whole
        plan.append((r["source"], r["source_size"], target, whole, 0.0 if rest < EPS else rest, math.ceil(r["n"] / block_rows)))
    known = spark.createDataFrame(plan, "key string, source_size long, target double, whole long, p double, blocks long")
    known = F.broadcast(known) if len(plan) <= 10_000 else known
    rows = in_blocks(sizes.join(known, F.col("source").eqNullSafe(F.col("key"))), block_rows)
    rows = rows.select("row", "doc_id", "source", "size", "source_size", "target", "whole", "block", "p")
    done, left = [rows.filter("p = 0")], rows.filter("p > 0")
    blocks, level = max([1, *(x[-1] for x in plan)]), 0
    while True:
        last = blocks == 1
        moved = cut(left.groupBy("source", "block").applyInArrow(_round(seed, level, last), STATE), "flight")
        done.append(moved if last else moved.filter("p = 0 or p = 1"))
        if last:
            break
        left = moved.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / fan_in))
        blocks, level = math.ceil(blocks / fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumn("copies", (F.col("whole") + F.col("p")).cast("long"))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns; rows are numbered and joined by number."""
    number, copies, copy = free_names(docs, "mix_row", "mix_copies", "mix_copy")
    rows = cut(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    taken = mix(rows, row=number, **options).filter("copies > 0").select(F.col("row").alias(number), F.col("copies").cast("int").alias(copies))
    # the numbers are the narrow side: hashed, so that texts are not sorted
    return rows.join(taken.hint("shuffle_hash"), number).withColumn(copy, F.explode(F.array_repeat(F.lit(True), F.col(copies)))).drop(number, copies, copy)

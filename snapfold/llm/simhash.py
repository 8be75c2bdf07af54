"""SimHash near-duplicate detection with vantage-point trees over 64-bit fingerprints.

Equal fingerprints are one point. A vantage-point tree is built from a bounded sample: each inner node has a point and a
radius. Every fingerprint goes down the tree; at a node, those inside the radius go to the inner branch, those outside
to the outer one, and by the triangle bound only those outside by at most `distance` bits also go to the inner branch.
So any two fingerprints within `distance` bits meet in at least one leaf shard. A shard is searched exactly in one task,
by the same rule again where it is large, and gives one edge for each point to the smallest of its local group, never
all pairs. Edges of all shards are joined to components by minimum labels with pointer jumping.

Edge cases: null, empty or blank text has fingerprint zero, linked like any other; fewer than three words are one
shingle; repeated rows are in one component and each stays in the result; a component of only null ids has a null id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.llm.common import as_bytes, cut, free_names, text_key

TREE_SEED = 11


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """SimHash of lower-cased word shingles, repeats included; a bit is set if over half the hashes have it."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [hashed(b" ".join(words), seed)]
    else:
        hashes = [hashed(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)))]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64)
    for lo in range(0, len(h), 65536):
        counts += np.unpackbits(h[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bits_apart(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose(points: np.ndarray, distance: int, rng) -> tuple[np.uint64, int] | None:
    """A vantage point and radius with few points in the overlap, and at least a fifth of the points on either side."""
    best = None
    for vantage in rng.choice(points, min(6, len(points)), replace=False):
        upto = np.cumsum(np.bincount(bits_apart(points, vantage), minlength=65 + distance))
        for radius in range(64):
            inner, n = int(upto[radius]), len(points)
            if n // 5 <= inner <= n - max(1, n // 5):
                work = (int(upto[radius + distance])) ** 1.3 + (n - inner) ** 1.3
                if best is None or work < best[0]:
                    best = work, vantage, radius
    return best and (best[1], best[2])


def build(sample: np.ndarray, leaves: int, distance: int) -> tuple:
    """A tree of nested (vantage, radius, inner, outer); a leaf is its number."""
    rng, count = np.random.default_rng(TREE_SEED), [0]
    small = max(8, len(sample) // max(1, leaves))

    def grow(points: np.ndarray):
        split = choose(points, distance, rng) if len(points) > small else None
        if split is None:
            count[0] += 1
            return count[0] - 1
        d = bits_apart(points, split[0])
        # home points alone decide how deep the tree grows; the overlap is only routed
        return int(split[0]), split[1], grow(points[d <= split[1]]), grow(points[d > split[1]])

    return grow(sample)


def route(tree, points: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, points that belong there)."""
    if not isinstance(tree, tuple):
        yield tree, points
    elif len(points):
        d = bits_apart(points, np.uint64(tree[0]))
        yield from route(tree[2], points[d <= tree[1] + distance], distance)
        yield from route(tree[3], points[d > tree[1]], distance)


def local_groups(points: np.ndarray, distance: int, small: int = 1024) -> Iterator[tuple[np.ndarray, int]]:
    """(members, smallest) of linked groups inside one shard; groups of one are left out."""
    rng = np.random.default_rng(TREE_SEED)
    stack = [np.unique(points)]
    while stack:
        todo = stack.pop()
        split = choose(todo, distance, rng) if len(todo) > small else None
        if split is not None:
            d = bits_apart(todo, split[0])
            inner, outer = todo[d <= split[1] + distance], todo[d > split[1]]
            if max(len(inner), len(outer)) <= 0.9 * len(todo):
                stack += [inner, outer]
                continue
        while len(todo):
            group, front, todo = [todo[:1]], [todo[0]], todo[1:]
            while front and len(todo):
                near = bits_apart(todo, front.pop()) <= distance
                if near.any():
                    found = todo[near]
                    group.append(found)
                    front.extend(found)
                    todo = todo[~near]
            if len(group) > 1:
                members = np.concatenate(group)
                yield members, members.min()


def shard_edges(points: DataFrame, distance: int, leaf_rows: int, sample_rows: int, max_leaves: int) -> DataFrame:
    """Edges (a, b): within its shard, fingerprint a is linked to b, the smallest of its group there."""
    n = points.count()
    leaves = min(max_leaves, -(-n // leaf_rows))
    most = max(sample_rows, 16 * leaves)
    some = points if n <= most else points.filter(F.pmod(F.xxhash64("fp"), F.lit(n)) < most)
    sample = np.sort(some.select("fp").toPandas()["fp"].to_numpy().astype(np.int64)).view(np.uint64)
    tree = build(sample, leaves, distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, part in route(tree, fps, distance):
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), leaf, np.int32)), pa.array(part.view(np.int64))], ["leaf", "fp"])

    def search(rows: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members, least in local_groups(rows["fp"].to_numpy().view(np.uint64), distance):
            a.append(members[members != least].view(np.int64))
            b.append(np.full(len(a[-1]), least, np.uint64).view(np.int64))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return points.select("fp").mapInArrow(deal, "leaf int, fp long").groupBy("leaf").applyInArrow(search, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node with an edge.

    Each round takes the smallest label of the neighbours, then the label of that label (pointer jumping), so chains
    shrink fast; every round is a written table, and the driver only gets the number of labels that changed.
    """
    edges = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        best = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = cut(best.join(jump, "near", "left").select("node", "old", F.least("near", "far").alias("label")), "labels")
        changed = step.filter("label <> old").count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, distance: int = 3, leaf_rows: int = 1024, sample_rows: int = 20_000, max_leaves: int = 65_536) -> DataFrame:
    """doc_id, fp, component_id of every row; every fingerprint is searched.

    A sample of about sample_rows fingerprints, or 16 for each of at most max_leaves leaves, shapes the tree and passes the
    driver; beyond that many leaves shards grow, and each is split further in its task.
    """
    prints = cut(fingerprints(docs, shingle, seed), "fingerprints")
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    labels = connected(shard_edges(points, distance, leaf_rows, sample_rows, max_leaves))
    owner = points.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = owner.groupBy("label").agg(F.min("first_id").alias("component_id"))
    owner = owner.join(least, "label").select("fp", "component_id")
    return prints.join(owner, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: the row with the smallest doc_id of each component stays, once.

    Rows that share an id are one document; rows without an id are told apart by their text.
    """
    one, count, text, nth = free_names(docs, "kept_id", "kept_rows", "own_text", "nth")
    found = near_duplicates(docs, **options)
    kept = cut(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(one)).agg(F.count("*").alias(count)), "kept")
    own = F.col("doc_id").cast("long")
    out = docs.join(kept.select(one), own.eqNullSafe(F.col(one)), "left_semi")
    if kept.filter(F.col(count) > 1).isEmpty():
        return out
    out = out.withColumn(text, F.when(F.col("doc_id").isNull(), text_key()))
    return out.withColumn(nth, F.row_number().over(W.partitionBy(own, text).orderBy("text"))).filter(F.col(nth) == 1).drop(text, nth)

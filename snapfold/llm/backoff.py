"""Language-model scores by stupid backoff, computed relationally from counts over the corpus itself.

The score of a word after its history is its relative count, or `alpha` times its score after a shorter history where the
longer n-gram was not seen; every document is scored by counts of all *other* documents, so it cannot support itself.

Documents are dealt to blocks of bounded size, and each block numbers its distinct words once. For n = 1, 2, ... each
block explodes its texts into distinct n-grams with counts (the partial aggregation) and sends them to the count table
of order n, which is partitioned by hash. The table groups equal n-grams, sums them, gives an id to each that several
blocks hold, and joins counts and ids back to the blocks that asked. Words are equal by their bytes; a longer n-gram is
the pair of the id of all its words but the last and the id of the last word, so no order rests on a hash being unique. An n-gram can only be
known elsewhere if both its shorter ones are, so only those are asked for. At last each block sums log scores for each
document. A frequent n-gram is sent once for each block, never once for each document, so no key gathers rows of all
documents. What a block sends to one partition is one row of packed numbers: at most one row for each n-gram, and far
fewer as long as partitions are few.

Log scores of words are rounded to millionths and summed as integers, so a sum does not depend on its order.

Edge cases: a null or blank text has no words, score 0 and perplexity null; documents of one or two words have
shorter histories; words seen in no other document count as half an occurrence; repeated rows are documents of
their own and support each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import Words, as_bytes, cut, mix64, scratch_path

_STEP = np.uint64(0x9E3779B97F4A7C15)
MICRO = 1_000_000


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed byte planes, as many as the largest needs."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def rising(x: np.ndarray) -> bytes:
    """Numbers in rising order, as their differences."""
    return packed(np.diff(x, prepend=0))


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, equal only for equal pairs of numbers from 0 on."""
    top = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * top < 1 << 63:
        return a * top + b
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    return a * (int(b.max(initial=0)) + 1) + b


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, text) as one compressed part for each block and batch."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        edge = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
        blocks, parts = [], []
        for lo, hi in zip(edge[:-1], edge[1:]):
            sink = pa.BufferOutputStream()
            rows = batch.select(["doc_id", "text"]).take(pa.array(order[lo:hi]))
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows)
            blocks.append(int(block[order[lo]]))
            parts.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.binary())], ["block", "part"])


BLOCK = "block long, docs binary, sizes binary, places binary, words binary"


def index_block(table: pa.Table) -> pa.Table:
    """The one row of a block: its ids, words of each text, number of the word at each place, and the distinct words."""
    docs = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table["part"].to_pylist()])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.select(["doc_id"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(docs.select(["doc_id"]))
    w = Words([x for chunk in docs["text"].chunks for x in as_bytes(chunk)])
    first, place = w.distinct()
    words = zlib.compress(b"\n".join([w.word(i) for i in first.tolist()]), 1)
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "sizes": pa.array([packed(w.counts)], pa.binary()), "places": pa.array([packed(place)], pa.binary()), "words": pa.array([words], pa.binary())})


def numbered(key: np.ndarray) -> np.ndarray:
    """The number of each key among the distinct ones."""
    order = np.argsort(key)
    ordered = key[order]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(np.concatenate([np.zeros(min(1, len(key)), bool), ordered[1:] != ordered[:-1]]))
    return number


@dataclass
class Order:
    """The n-grams of one order in a block: that of each place (-1: none ends there), and of each distinct one its count in
    the block, its count elsewhere and its id (0: in no other block)."""

    place: np.ndarray
    counts: np.ndarray
    elsewhere: np.ndarray | None = None
    ids: np.ndarray | None = None


class Block:
    """A block's texts as numbers, with what the count tables said so far (columns counts1, ids1, counts2, ...)."""

    def __init__(self, row: dict, parts: int):
        self.row, self.parts = row, parts
        self.sizes, self.words = unpacked(row["sizes"]), unpacked(row["places"])
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.inner = np.ones(len(self.words), bool)  # places with a word of the same text before
        self.inner[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = False
        self.orders: list[Order] = []
        while f"counts{len(self.orders) + 1}" in row:
            n = len(self.orders) + 1
            order = self.next_order()
            order.elsewhere, order.ids = unpacked(row[f"counts{n}"]), unpacked(row[f"ids{n}"])
            self.orders.append(order)

    def next_order(self) -> Order:
        """The n-grams of the order behind those that are known."""
        if not self.orders:
            return Order(self.words, np.bincount(self.words) if len(self.words) else np.zeros(0, np.int64))
        before = np.concatenate([np.full(min(1, len(self.words)), -1), self.orders[-1].place[:-1]])
        there = np.flatnonzero(self.inner & (before >= 0))
        number = numbered(pairs(before[there], self.words[there]))
        place = np.full(len(self.words), -1)
        place[there] = number
        return Order(place, np.bincount(number) if len(number) else np.zeros(0, np.int64))

    def wanted(self, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Distinct n-grams to ask for, by partition and there by the first id of their names: their numbers, their
        partitions and (beyond words) the names, pairs of ids."""
        if not self.orders:
            w = Words([zlib.decompress(self.row["words"])])
            part = (w.hash % np.uint64(self.parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            return by, part[by], None
        last, words = self.orders[-1], self.orders[0]
        # any place of an n-gram tells its words
        at = np.zeros(len(order.counts), np.int64)
        ends = np.flatnonzero(order.place >= 0)
        at[order.place[ends]] = ends
        which = np.flatnonzero((last.ids[last.place[at - 1]] > 0) & (last.ids[last.place[at]] > 0))
        a, b = last.ids[last.place[at[which] - 1]], words.ids[words.place[at[which]]]
        by = np.argsort(a, kind="stable")
        which, a, b = which[by], a[by], b[by]
        with np.errstate(over="ignore"):
            part = (mix64(mix64(a.astype(np.uint64) * _STEP) ^ b.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)
        by = np.argsort(part.astype(np.uint16) if self.parts <= 1 << 16 else part, kind="stable")
        return which[by], part[by], np.stack([a[by], b[by]])


SENT = "block long, part int, names binary, more binary, counts binary"


def requests(table: pa.Table, parts: int) -> pa.Table:
    """What a block asks of the count table of the next order: a row for each partition."""
    block = Block(table.to_pylist()[0], parts)
    order = block.next_order()
    which, part, names = block.wanted(order)
    counts = order.counts[which]
    edge = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(edge[:-1] < edge[1:]).tolist()
    cuts = [slice(edge[p], edge[p + 1]) for p in full]
    if names is None:
        words = zlib.decompress(block.row["words"]).split(b"\n")
        first, more = [zlib.compress(b"\n".join([words[i] for i in which[c].tolist()]), 1) for c in cuts], [b""] * len(cuts)
    else:
        first, more = [rising(names[0][c]) for c in cuts], [packed(names[1][c]) for c in cuts]
    return pa.table({
        "block": pa.array([block.row["block"]] * len(full), pa.int64()),
        "part": pa.array(full, pa.int32()),
        "names": pa.array(first, pa.binary()),
        "more": pa.array(more, pa.binary()),
        "counts": pa.array([packed(counts[c]) for c in cuts], pa.binary()),
    })


def replies(table: pa.Table, parts: int, with_ids: bool) -> pa.Table:
    """One partition of a count table: groups equal n-grams, sums their counts, and joins back to each block how often the
    others hold each of its n-grams, and the ids of those that are held elsewhere (frequent ones have small ids)."""
    names, more = table["names"].to_pylist(), table["more"].to_pylist()
    counts = [unpacked(x) for x in table["counts"].to_pylist()]
    if more[0]:
        place = numbered(pairs(np.concatenate([np.cumsum(unpacked(x)) for x in names]), np.concatenate([unpacked(x) for x in more])))
    else:
        _, place = Words([zlib.decompress(x) for x in names]).distinct()
    total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
    ids = np.empty(len(total), np.int64)
    ids[np.argsort(-total, kind="stable")] = np.arange(len(total)) * parts + table["part"][0].as_py() + 1
    out_counts, out_ids, at = [], [], 0
    for c in counts:
        own = place[at : at + len(c)]
        rest = total[own] - c
        out_counts.append(packed(rest))
        out_ids.append(packed(ids[own[rest > 0]]) if with_ids else b"")
        at += len(c)
    return pa.table({"block": table["block"], "part": table["part"], "counts": pa.array(out_counts, pa.binary()), "ids": pa.array(out_ids, pa.binary())})


def told(block: Block, answers: pa.Table) -> Order:
    """The next order of a block with what the count table answered."""
    order = block.next_order()
    order.elsewhere, order.ids = np.zeros(len(order.counts), np.int64), np.zeros(len(order.counts), np.int64)
    said = sorted(zip(*(answers[c].to_pylist() for c in ("part", "counts", "ids"))))
    if said:
        asked, _, _ = block.wanted(order)
        counts = np.concatenate([unpacked(c) for _, c, _ in said])
        order.elsewhere[asked] = counts
        if said[0][2]:
            order.ids[asked[counts > 0]] = np.concatenate([unpacked(i) for _, _, i in said])
    return order


def log_scores(block: Block, alpha: float, words: int) -> np.ndarray:
    """Sum of the log scores of each text's words, in millionths."""
    rest = np.maximum(1, words - block.sizes)[block.text].astype(float)
    score, before = np.zeros(0), np.zeros(0)
    for n, order in enumerate(block.orders, 1):
        there = order.place >= 0
        counts = np.zeros(len(there), np.int64)
        if there.any():
            own = numbered(pairs(block.text[there], order.place[there]))  # a text's own n-grams
            counts[there] = (order.counts + order.elsewhere)[order.place[there]] - np.bincount(own)[own]
        if n == 1:
            score = np.maximum(counts, 0.5) / rest
        else:
            context = np.maximum(1, np.concatenate([[0], before[:-1]]))[: len(counts)]
            score = np.where(counts > 0, counts / context, np.where(there, alpha * score, score))
        before = counts
    micro = np.rint(np.log(score) * MICRO).astype(np.int64)
    ends = np.cumsum(block.sizes)
    sums = np.concatenate([[0], np.cumsum(micro)])
    return sums[ends] - sums[ends - block.sizes]


#: Spark takes at most 100,000 buckets; twice as many blocks get numbers from the driver, more than that need none.
MOST_BUCKETS = 20_000


def block_numbers(docs: DataFrame, blocks: int, buckets: int) -> np.ndarray | None:
    """Numbers for blocks that Spark's hash deals evenly to buckets; none where the blocks of a bucket are so many that
    plain numbers are dealt evenly enough. The table has at most 80 rows for each of MOST_BUCKETS."""
    if blocks > 2 * buckets:
        return None
    spread = docs.sparkSession.range(8 * blocks + 64 * buckets).select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket")).toPandas()
    nth = spread.groupby("bucket").cumcount()
    return spread.assign(nth=nth).sort_values(["nth", "bucket"])["id"].to_numpy()[:blocks].astype(np.int64)


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, block_bytes: int = 8 << 20, part_bytes: int = 12 << 20, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs) and perplexity of every row."""
    spark = docs.sparkSession
    # the place in the table tells repeated rows apart, so that they are dealt to all blocks
    deal = F.xxhash64("doc_id", F.monotonically_increasing_id())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    blocks, parts = max(1, -(-size // block_bytes)), max(1, -(-size // part_bytes))
    buckets = min(most_buckets, max(1, -(-blocks // 2)))
    numbers = block_numbers(docs, blocks, buckets)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(blocks)).astype(np.int64)
            which = which if numbers is None else numbers[which]
            yield from pack([pa.RecordBatch.from_arrays([pa.array(which), batch.column(1), batch.column(2)], ["block", "doc_id", "text"])])

    dealt = rows.select(deal.alias("block"), "doc_id", "text").mapInArrow(number, "block long, part binary")
    indexed = dealt.repartition(buckets, "block").groupBy("block").applyInArrow(index_block, BLOCK)
    names: list[str] = []

    def by_block(df: DataFrame) -> DataFrame:
        """A table bucketed by block: later steps read it beside others without a shuffle."""
        names.append(f"snapfold_blocks_{uuid.uuid4().hex}")
        df.write.bucketBy(buckets, "block").sortBy("block").option("path", scratch_path(spark, "blocks")).option("compression", "none").saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        known = by_block(indexed)

        def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([int(unpacked(x).sum()) for x in batch.column(0).to_pylist()], pa.int64())], ["n"])

        words = known.select("sizes").mapInArrow(total_of, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

        def answer(n: int) -> DataFrame:
            sent = known.groupBy("block").applyInArrow(lambda t: requests(t, parts), SENT)
            return sent.groupBy("part").applyInArrow(lambda t: replies(t, parts, n < order), "block long, part int, counts binary, ids binary").repartition(buckets, "block")

        def keep(t: pa.Table, answers: pa.Table) -> pa.Table:
            if not t.num_rows:
                return pa.table({"block": pa.array([], pa.int64()), "counts": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
            block = Block(t.to_pylist()[0], parts)
            got = told(block, answers)
            return pa.table({"block": pa.array([block.row["block"]], pa.int64()), "counts": pa.array([packed(got.elsewhere)], pa.binary()), "ids": pa.array([packed(got.ids)], pa.binary())})

        for n in range(1, order):
            said = by_block(known.groupBy("block").cogroup(answer(n).groupBy("block")).applyInArrow(keep, "block long, counts binary, ids binary"))
            known = known.join(said.select("block", F.col("counts").alias(f"counts{n}"), F.col("ids").alias(f"ids{n}")).hint("merge"), "block")

        def score(t: pa.Table, answers: pa.Table) -> pa.Table:
            block = Block(t.to_pylist()[0], parts)
            block.orders.append(told(block, answers))
            docs_ = pa.ipc.open_stream(block.row["docs"]).read_all()
            return pa.table({"doc_id": docs_["doc_id"], "n_words": pa.array(block.sizes, pa.int64()), "micro": pa.array(log_scores(block, alpha, words), pa.int64())})

        scored = cut(known.groupBy("block").cogroup(answer(order).groupBy("block")).applyInArrow(score, "doc_id long, n_words long, micro long"), "scores")
    finally:
        for name in names:
            spark.sql(f"drop table if exists {name}")
    out = scored.select("doc_id", "n_words", (F.col("micro") / MICRO).alias("log_score"))
    return out.withColumn("perplexity", F.when(F.col("n_words") > 0, F.round(F.exp(-F.col("log_score") / F.col("n_words")), 3)))

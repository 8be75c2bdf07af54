"""Phrase collocations: phrases of 2 to `longest` words that occur `least` times or more, scored by how much they stick together.

Stripes pattern. Texts are packed into blocks of one language, whose words are numbered there. For each phrase of n words a
block has a stripe: how often each word follows it. Stripes of all blocks are dealt by phrase and merged elementwise; the merged
stripes give the phrases of n + 1 words (extensions that occur `least` times or more) with their counts, which are also the
totals of the stripes one word longer, and the largest extension of each phrase, which decides whether a longer one takes its
place. The extensions are told to the blocks that hold them, which then know where they stand; the next round looks only at
places where both the first and the last n words are frequent, since no other can start a longer one. Counts are exact:
words are compared by their bytes, phrases by the numbers of their parts.

A phrase's stripe is split by following word into one part for each `share` of its occurrences, which are known from the
round before; so a phrase of a third of all rows is many small groups. Parts are dealt in bundles, one for each task that
merges and at most `_BUNDLES`: a block sends a row for each bundle and each `most` counts, so rows grow in proportion to the
input. All blocks sort a bundle by phrase, so its rows are merged as they pass. Only stripes and answers are
shuffled; texts are read once. Blocks stay where they are: their tables are bucketed by block, and only answers move. A block
knows only its own words, and nothing is broadcast.

Scores: cutting a phrase after k words gives a * n / (l * r), of which the smallest counts. l and r are counts of the first
and last words, which the rounds before found; products are decimals of 38 digits.

Edge cases: a null text is empty, a null language `und`; empty tables and texts without words give nothing; repeated rows
count each time; a word of any length stays whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapfold.llm.common import Words, as_bytes, cut, mix64, slices
from snapfold.sources.together import Together

#: Lower case, and one mark for all that ends a piece; blanks and tabs stay.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bundles of stripes at most; more would leave a block few counts for each.
_BUNDLES = 1024
_STATE = "block long, lang string, pos binary, gram binary, last binary, grams array<long>, sizes array<long>, words array<long>"


def packed(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers, below 2 ** 32 unless kind is longer, compressed by byte planes."""
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1 if len(x) else 1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of numbers of seven bits a byte, low ones first, and how many bytes each has."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1 << 7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[start[at] + k] = ((x[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def from_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    start = np.append(0, ends[:-1])
    within = np.arange(len(data)) - np.repeat(start, ends - start)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * within).astype(np.uint64), start).astype(np.int64)


def lists(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Runs of values, which begin at `first`."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), pa.array(values, pa.int64()))


def stripe_bytes(after: np.ndarray, n: np.ndarray, start: np.ndarray, first: np.ndarray) -> pa.Array:
    """Of stripes that begin at `start`: how far each following word is from the one before, and its count. A value holds the
    stripes from one of `first` to the next."""
    step = np.diff(after, prepend=0)
    step[start] = after[start]
    data, size = varints(np.column_stack([step, n]).ravel())
    before = np.append(0, np.cumsum(size.reshape(-1, 2).sum(axis=1)))
    offsets = before[np.append(first, len(after))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def from_stripes(column: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Following words and counts of all stripes, which have so many entries."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = from_varints(np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    total, n = np.cumsum(values[::2]), values[1::2]
    before = np.append(0, total)[np.cumsum(sizes) - sizes]
    return total - np.repeat(before, sizes), n


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, lang, words (distinct, most frequent first), counts, ids (number of each word of the block's texts) and pos.

    Places are counted so that a piece's last word and the next one's first are not neighbours.
    """

    def row(block: int, lang: str, texts: list[bytes]) -> pa.RecordBatch | None:
        numbers: dict[bytes, int] = {}
        ids, pos, free = [], [], 0
        for lo, hi in slices(texts):
            w = Words([t.translate(_PLAIN) for t in texts[lo:hi]])
            if not len(w.start):
                continue
            (first, place), joined = w.distinct(), w.buf.tobytes()
            own = np.array([numbers.setdefault(joined[i:j], len(numbers)) for i, j in zip(w.start[first].tolist(), w.end[first].tolist())], np.int32)
            ids.append(own[place])
            ends = np.searchsorted(np.flatnonzero(w.buf == 10), w.start)
            pos.append(free + np.arange(len(ends)) + np.cumsum(np.diff(ends, prepend=ends[0]) > 0))
            free = pos[-1][-1] + 2
        if not ids:
            return None
        place, pos = np.concatenate(ids), np.concatenate(pos)
        counts = np.bincount(place)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        words = list(numbers)
        words = [words[i] for i in order.tolist()]
        each = [[block], [lang], [words], [counts[order]], [packed(rank[place])], [packed(np.diff(pos, prepend=0))]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(each, (pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()))], ["block", "lang", "words", "counts", "ids", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            for lang in sorted(held):
                if (out := row(number, lang, held.pop(lang))) is not None:
                    yield out
                number += 1
            size = 0

        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                for lang, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                    if size >= block_bytes:
                        yield from flush()
        yield from flush()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "block long, lang string, words array<binary>, counts array<long>, ids binary, pos binary")


def frequent_words(made: DataFrame, least: int) -> DataFrame:
    """block, nth (number of the word in the block), gram (its number everywhere), a (its count), lang and word."""
    each = made.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("nth", "x"))
    each = each.select("block", "lang", "nth", F.col("x.words").alias("word"), F.col("x.counts").alias("n")).repartition("lang", "word")
    word, place = W.partitionBy("lang", "word"), F.monotonically_increasing_id()
    # numbers stay small, so that they need few bytes
    number = place.bitwiseAND((1 << 33) - 1) * wide(made) + F.shiftright(place, 33) + 1
    each = each.withColumn("number", number).withColumns({"a": F.sum("n").over(word), "gram": F.min("number").over(word)})
    return cut(each.filter(F.col("a") >= least).select("block", "nth", "gram", "a", "lang", "word"), "phrase-words")


def told(words: DataFrame, at_once: int = 500_000) -> DataFrame:
    """block, and nth, gram and a of its frequent words as packed numbers: a row for each block of some `at_once` rows."""

    def rows(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches)
        block, *each = (numbers(whole, c) for c in ("block", "nth", "gram", "a"))
        order = np.lexsort((each[0], block))
        block, nth, gram, a = (x[order] for x in (block, *each))
        first = np.flatnonzero(np.diff(block, prepend=-1))
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(block)]))
        columns = [[packed(np.diff(nth[i:j], prepend=0)) for i, j in cuts], *([packed(x[i:j], "<u8") for i, j in cuts] for x in (gram, a))]
        return pa.RecordBatch.from_arrays([pa.array(block[first]), *(pa.array(c, pa.binary()) for c in columns)], ["block", "nth", "gram", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= at_once:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    return words.select("block", "nth", "gram", "a").mapInArrow(run, "block long, nth binary, gram binary, a binary")


def wide(df: DataFrame) -> int:
    """At least as many as a shuffle has partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def state_row(block: int, lang: str, pos, gram, last, grams, sizes, words) -> pa.Table:
    """last: None where it is the same as gram."""
    each = [[block], [lang], [packed(np.diff(pos, prepend=0))], [packed(gram)], [None if last is None else packed(last)], [grams], [sizes], [words]]
    kinds = (pa.int64(), pa.string(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 3)
    return pa.table([pa.array(x, t) for x, t in zip(each, kinds)], names=["block", "lang", "pos", "gram", "last", "grams", "sizes", "words"])


_NONE = pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 3)], names=["block", "lang", "pos", "gram", "last", "grams", "sizes", "words"])


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def only(table: pa.Table | pa.RecordBatch, i: int = 0) -> dict:
    """Row i; its lists are numpy arrays."""
    row = {c: table.column(c)[i] for c in table.schema.names}
    return {c: x.values.to_numpy() if isinstance(x, pa.ListScalar) else x.as_py() for c, x in row.items()}


def words_placed(block: pa.Table, answers: pa.Table) -> pa.Table:
    """State of a block: the places of frequent words, and which of `grams` (with count `sizes`) and `words` stands there."""
    if not block.num_rows or not answers.num_rows:
        return _NONE
    row = only(block)
    ids, pos = unpacked(row["ids"]), np.cumsum(unpacked(row["pos"]))
    nth = np.concatenate([np.cumsum(unpacked(x)) for x in answers.column("nth").to_pylist()])
    gram, a = (np.concatenate([unpacked(x, "<u8") for x in answers.column(c).to_pylist()]) for c in ("gram", "a"))
    order = np.argsort(nth)
    nth, gram, a = nth[order], gram[order], a[order]
    new = np.full(int(ids.max()) + 1, -1)
    new[nth] = np.arange(len(nth))
    at = new[ids]
    keep = at >= 0
    return state_row(row["block"], row["lang"], pos[keep], at[keep], None, gram, a, gram)


def read(state: dict) -> tuple[np.ndarray, ...]:
    """pos, gram and last of a block, and where a frequent phrase starts at this place and at the next."""
    pos = np.cumsum(unpacked(state["pos"]))
    gram = unpacked(state["gram"])
    return pos, gram, gram if state["last"] is None else unpacked(state["last"]), np.flatnonzero(pos[1:] == pos[:-1] + 1)


def phrases_placed(block: pa.Table, answers: pa.Table) -> pa.Table:
    """The state with phrases of one word more, of which answers has the frequent ones."""
    if not block.num_rows or not answers.num_rows:
        return _NONE
    row = only(block)
    pos, gram, last, at = read(row)
    grams, words = row["grams"], row["words"]
    by_gram, by_word = np.argsort(grams), np.argsort(words)
    prefix, after, new, a = (np.concatenate([x.flatten().to_numpy() for x in answers.column(c).chunks]) for c in ("prefix", "after", "gram", "a"))
    known = by_gram[np.searchsorted(grams, prefix, sorter=by_gram)] * len(words) + by_word[np.searchsorted(words, after, sorter=by_word)]
    order = np.argsort(known)
    known = known[order]
    key = gram[at] * len(words) + last[at + 1]
    found = np.minimum(np.searchsorted(known, key), len(known) - 1)
    hit = known[found] == key
    return state_row(row["block"], row["lang"], pos[at][hit], found[hit], last[at + 1][hit], new[order], a[order], words)


def stripes(states: DataFrame, share: int, bundles: int, most: int = 1_000) -> DataFrame:
    """bundle, block, and of the stripes in it prefix (ascending), size (entries) and stripe (following words and counts).

    A row holds up to `most` entries; the next rows of a block in a bundle go on from there.
    """

    def rows(state: dict) -> pa.RecordBatch | None:
        _, gram, last, at = read(state)
        grams, sizes, words = (state[c] for c in ("grams", "sizes", "words"))
        pairs = gram[at] * len(words)
        pairs += last[at + 1]
        if not len(pairs):
            return None
        pairs.sort()
        start = np.flatnonzero(np.diff(pairs, prepend=-1))
        pairs, n = pairs[start], np.diff(np.append(start, len(pairs)))
        own, after = pairs // len(words), words[pairs % len(words)]
        prefix = grams[own]
        part = mix64(after.view(np.uint64)) % (1 + sizes[own] // share).astype(np.uint64)
        bundle = (mix64(mix64(prefix.view(np.uint64)) + part) % np.uint64(bundles)).astype(np.int64)
        order = np.lexsort((after, prefix, bundle))
        bundle, prefix, after, n = (x[order] for x in (bundle, prefix, after, n))
        begin = np.flatnonzero(np.diff(bundle, prepend=-1))
        within = np.arange(len(bundle)) - np.repeat(begin, np.diff(np.append(begin, len(bundle))))
        starts = within % most == 0
        start = np.flatnonzero((np.diff(prefix, prepend=-1) != 0) | starts)
        first = np.flatnonzero(starts[start])
        heads, data = lists(prefix[start], first), stripe_bytes(after, n, start, start[first])
        size = lists(np.diff(np.append(start, len(after))), first)
        return pa.RecordBatch.from_arrays([pa.array(bundle[start[first]]), pa.array(np.full(len(first), state["block"])), heads, size, data], ["bundle", "block", "prefix", "size", "stripe"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if (out := rows(only(batch, i))) is not None:
                    yield from (out.slice(j, 500) for j in range(0, out.num_rows, 500))

    return states.mapInArrow(run, "bundle long, block long, prefix array<long>, size array<long>, stripe binary")


MERGED = ("prefix", "after", "gram", "a")


def merged(each: DataFrame, least: int, at_once: int = 500_000, bundles: int | None = None) -> DataFrame:
    """kind, block, and arrays prefix, after, gram, a of merged stripes.

    kind 0 tells a block which of its phrases are frequent; 1 are frequent phrases, numbered; 2 are prefixes with their largest
    extension (a). Rows of a bundle are sorted by their first prefix and merged as they pass, some `at_once` counts at a time: what
    lies before the next row's first prefix is whole, and the rest waits. A row holds what one such step has to say, to one
    block.
    """
    fields = ", ".join(["kind long", "block long", *(f"{c} array<long>" for c in MERGED)])
    every = wide(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = TaskContext.get().partitionId() + 1, 0
        #: prefix, after, n and block of counts that are not whole yet
        waits = [np.zeros(0, np.int64)] * 4

        def say(kind: int, block: int, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([block]), *(pa.array([c.astype(np.int64)], pa.list_(pa.int64())) for c in columns)], ["kind", "block", *MERGED])

        def merge(rows: list[pa.RecordBatch], before: int | None = None) -> Iterator[pa.RecordBatch]:
            """Of rows and what waits, all prefixes, or only those below `before`."""
            nonlocal number, waits
            whole = pa.Table.from_batches(rows)
            joined = {c: pa.concat_arrays(whole.column(c).chunks) for c in ("block", "prefix", "size", "stripe")}
            sizes = joined["size"].flatten().to_numpy()
            after, n = from_stripes(joined["stripe"], sizes)
            prefix = np.repeat(joined["prefix"].flatten().to_numpy(), sizes)
            block = np.repeat(np.repeat(joined["block"].to_numpy(), joined["prefix"].value_lengths().to_numpy()), sizes)
            prefix, after, n, block = (np.concatenate([x, y]) for x, y in zip(waits, (prefix, after, n, block)))
            late = prefix >= before if before is not None else np.zeros(len(prefix), bool)
            waits = [x[late] for x in (prefix, after, n, block)]
            if late.all():
                return
            prefix, after, n, block = (x[~late] for x in (prefix, after, n, block))
            order = np.lexsort((after, prefix))
            prefix, after, block = prefix[order], after[order], block[order]
            start = np.flatnonzero((np.diff(prefix, prepend=-1) != 0) | (np.diff(after, prepend=-1) != 0))
            a = np.add.reduceat(n[order], start)
            good = a >= least
            gram = np.where(good, (number + np.cumsum(good) - 1) * every + own, 0)
            number += int(good.sum())
            back = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(prefix))))
            kept = np.flatnonzero(good[back])
            kept = kept[np.argsort(block[kept], kind="stable")]
            to = np.flatnonzero(np.diff(block[kept], prepend=-1))
            for lo, hi in zip(to, np.append(to[1:], len(kept))):
                at = kept[lo:hi]
                yield say(0, int(block[at[0]]), prefix[at], after[at], gram[back[at]], a[back[at]])
            won = start[good]
            yield say(1, 0, prefix[won], after[won], gram[good], a[good])
            head = np.flatnonzero(np.diff(prefix[won], prepend=-1))
            if len(head):
                yield say(2, 0, prefix[won][head], 0 * head, 0 * head, np.maximum.reduceat(a[good], head))

        rows, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bundle = batch.column("bundle").to_numpy()
            stripes_in = batch.column("size").value_lengths().to_numpy()
            entries = np.add.reduceat(batch.column("size").flatten().to_numpy(), np.cumsum(stripes_in) - stripes_in)
            steps = np.cumsum(entries) // at_once
            cuts = np.flatnonzero((np.diff(bundle, prepend=-1) != 0) | (np.diff(steps, prepend=-1) != 0))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bundle)]):
                if rows and bundle[lo] != last:
                    yield from merge(rows)
                    rows, size = [], 0
                elif size >= at_once:
                    yield from merge(rows, batch.column("prefix")[lo].values[0].as_py())
                    rows, size = [], 0
                rows.append(batch.slice(lo, hi - lo))
                size, last = size + int(entries[lo:hi].sum()), bundle[lo]
        if rows:
            yield from merge(rows)

    dealt = each.repartitionById(bundles or every, F.col("bundle").cast("int")).sortWithinPartitions("bundle", F.col("prefix")[0])
    return cut(dealt.mapInArrow(run, fields), "phrase-stripes")


def said(stripe: DataFrame, kind: int) -> DataFrame:
    """Rows prefix, after, gram, a of one kind."""
    return stripe.filter(F.col("kind") == kind).select(F.inline(F.arrays_zip(*MERGED)))


def with_parts(grams: DataFrame, shorter: DataFrame, first: bool) -> DataFrame:
    """grams (prefix, after, gram, a) with lang, phrase, last word, tail (its last n - 1 words' number), and lead and rear:
    counts of its first and last 1, 2, ... words. shorter: the same of one word less."""
    p = shorter.select(F.col("gram").alias("prefix"), "lang", F.col("phrase").alias("head"), F.col("tail").alias("mid"), F.col("lead").alias("lead_before"))
    s = shorter.select(F.col("gram").alias("tail"), "last", F.col("rear").alias("rear_before"), *([] if first else [F.col("prefix").alias("mid"), "after"]))
    s = s.withColumnRenamed("tail", "after").withColumn("tail", F.col("after")) if first else s
    out = grams.join(p, "prefix").join(s, ["after"] if first else ["mid", "after"])
    grown = lambda c: F.concat(F.col(f"{c}_before"), F.array("a")).alias(c)
    return out.select("gram", "prefix", "after", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "tail", "a", grown("lead"), grown("rear"))


def scored(grams: DataFrame, totals: DataFrame, words: int) -> DataFrame:
    """With l, r, n and score at the cut of the lowest score, the first of those."""
    wide = lambda x: f"cast({x} as decimal(19, 0))"
    cuts = []
    for k in range(1, words):
        left, right = f"lead[{k - 1}]", f"rear[{words - k - 1}]"
        score = F.expr(f"({wide('1000 * a')} * {wide('n')}) div ({wide(left)} * {wide(right)})")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r")))
    return grams.join(totals, "lang").withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, covered: int = 100, top: int = 2000, block_bytes: int = 14 << 20, share: int = 1 << 17) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best `top` phrases of each language.

    A phrase goes if a longer one that holds it has `covered` hundredths of its count or more.
    """
    home = Together(docs.sparkSession, key="block")
    made = home.hold(blocks(docs, block_bytes))
    totals = made.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = frequent_words(made, least)
    state = home.hold(made.select("block", "lang", "ids", "pos").groupBy("block").cogroup(told(words).groupBy("block")).applyInArrow(words_placed, _STATE))
    totals = cut(totals, "phrase-totals")
    # bundles of some four shares at least
    bundles = min(wide(docs), 1 + (totals.agg(F.sum("n")).first()[0] or 0) // (4 * share), _BUNDLES)
    home.forget([state])
    one = words.groupBy("gram").agg(F.first("lang").alias("lang"), F.first("word").cast("string").alias("phrase"), F.first("a").alias("a"))
    shorter = cut(one.select("gram", F.lit(0).cast("long").alias("prefix"), F.col("gram").alias("after"), "lang", "phrase", F.col("phrase").alias("last"), F.lit(0).cast("long").alias("tail"), "a", F.array("a").alias("lead"), F.array("a").alias("rear")), "phrase-words")
    found = []
    for n in range(2, longest + 1):
        stripe = merged(stripes(state, share, bundles), least, bundles=bundles)
        shorter = cut(with_parts(said(stripe, 1), shorter, n == 2), "phrases")
        longer_first = said(stripe, 2).groupBy(F.col("prefix").alias("gram")).agg(F.max("a").alias("first"))
        longer_last = shorter.groupBy(F.col("tail").alias("gram")).agg(F.max("a").alias("last_a"))
        if found:
            grams, at = found[-1]
            grams = grams.join(longer_first, "gram", "left").join(longer_last, "gram", "left")
            inside = 100 * F.greatest(F.coalesce("first", F.lit(0)), F.coalesce("last_a", F.lit(0))) >= covered * F.col("a")
            found[-1] = grams.filter(~inside), at
        found.append((shorter, n))
        if n < longest:
            state = home.hold(state.groupBy("block").cogroup(stripe.filter("kind = 0").select("block", "prefix", "after", "gram", "a").groupBy("block")).applyInArrow(phrases_placed, _STATE))
            home.forget([state])
    home.forget()
    every = None
    for grams, n in found:
        part = scored(grams, totals, n)
        every = part if every is None else every.unionByName(part)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = spread.withColumn("nth", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("nth") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

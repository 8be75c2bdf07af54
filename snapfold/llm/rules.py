"""Quality rules, and an isolation forest on their statistics.

Every document's rule statistics come from one pass over its whole text. A forest of random splits is grown on a bounded
sample of labelled good rows; a document that few splits isolate, because its statistics are far from all of those,
has a short mean path and a high score. The score from which documents are rejected is calibrated on the labelled rows
of one of two folds, a good row rejected weighing `good_cost` bad rows kept; `held_out` gives the figures of the other
fold. Base rules reject by themselves.

Edge cases: a null or blank text has no words and fails the base rules; repeated rows give repeated rows; without
labelled good rows the forest is grown on a sample of all rows and only the base rules reject; labels without id or
quality are ignored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import cut, each_text

BLANK = bytes([0x20, *range(0x09, 0x0E)])
NOT_CODE_POINT = BLANK + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in SYMBOLS)
UPPER = bytes(range(65, 91))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Length is no fault, so no statistic of it takes part.
FEATURES = ("f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_stutter", "f_upper", "f_marks", "f_variety", "f_top_word")
STATS = ", ".join(["doc_id long", *(f"{b} long" for b in BASE), *(f"{f} double" for f in FEATURES)])
WINDOW = 8
RUN = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more, the first included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            h = (h ^ ids[k : k + n]) * _STEP
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(n, bool)
    starts[order[1:][same]] = starts[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple:
    """The BASE counts, then the FEATURES, of one text."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    dup = len(lines) - len(set(lines))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    if not n:
        return (0, 0, symbols, dup, 0, *[0.0] * len(FEATURES))
    chars = len(text.translate(None, NOT_CODE_POINT))
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeats = repeat_words(ids)
    _, counts = np.unique(ids, return_counts=True)
    # distinct words in runs of the same size, so that long texts are measured as short ones
    run = np.arange(n) // RUN
    order = np.lexsort((ids, run))
    fresh = n - int(((ids[order[1:]] == ids[order[:-1]]) & (run[order[1:]] == run[order[:-1]])).sum())
    variety = np.log1p(fresh / (run[-1] + 1)) / np.log1p(n / (run[-1] + 1))
    stutter = int((ids[1:] == ids[:-1]).sum())
    upper = len(text) - len(text.translate(None, UPPER))
    marks = len(text) - len(text.translate(None, MARKS))
    return (n, chars, symbols, dup, repeats, chars / n, symbols / n, dup / len(lines), repeats / n, stutter / n, upper / chars, marks / n, float(variety), int(counts.max()) / n)


def statistic_columns(texts: Iterable[bytes]) -> list[pa.Array]:
    columns = list(zip(*map(statistics, texts))) or [[]] * (len(BASE) + len(FEATURES))
    return [pa.array(c, pa.int64() if i < len(BASE) else pa.float64()) for i, c in enumerate(columns)]


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the BASE counts and FEATURES of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *statistic_columns(each_text(batch.column(1)))], ["doc_id", *BASE, *FEATURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, STATS)


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


class Forest:
    """Isolation trees in arrays: node i has the children 2i+1 and 2i+2."""

    def __init__(self, rows: np.ndarray, spread: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 5, widen: float = 1.0):
        """A split is drawn from the node's range and `widen` of it, plus of the spread among all rows, on either side:
        so statistics beyond those of the sample are cut off early, also where the sample has a single value."""
        self.spread, self.widen = spread, widen
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
        nodes = (2 << self.depth) - 1
        self.feature = np.full((trees, nodes), -1, np.int8)
        self.cut = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        self.norm = max(mean_path(sample), 1e-9)
        for t in range(trees):
            self._grow(t, 0, 0, rows[rng.choice(len(rows), sample, replace=False)], rng)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng) -> None:
        lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (self.spread, self.spread)
        more = self.widen * (hi - lo) + 0.25 * self.spread
        lo, hi = lo - more, hi + more
        wide = np.flatnonzero(hi > lo)
        if depth == self.depth or not len(rows) or not len(wide):
            self.path[t, node] = depth + mean_path(len(rows))
            return
        f = rng.choice(wide)
        at = rng.uniform(lo[f], hi[f])
        self.feature[t, node], self.cut[t, node] = f, at
        above = rows[:, f] > at
        self._grow(t, 2 * node + 1, depth + 1, rows[~above], rng)
        self._grow(t, 2 * node + 2, depth + 1, rows[above], rng)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits isolate."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, at, path in zip(self.feature, self.cut, self.path):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                deeper = 2 * node + 1 + (rows[every, f] > at[node])
                node = np.where(f >= 0, deeper, node)
            total += path[node]
        return np.exp2(-total / len(self.path) / self.norm)


def calibrate(labelled: DataFrame, good_cost: float, bins: int = 4096) -> float:
    """Of labelled (score, quality) rows: the score from which to reject, where a good row rejected costs good_cost bad
    rows kept; the middle of equally good ones. Without labelled rows of both kinds nothing is rejected."""
    # counts by bin, not rows, pass the driver
    counts = labelled.groupBy(F.floor(F.col("score") * bins).alias("bin"), "quality").count().collect()
    good, bad = np.zeros(bins + 2), np.zeros(bins + 2)
    for r in counts:
        (good if r["quality"] == 1 else bad)[min(max(r["bin"], 0), bins)] += r["count"]
    if not good.sum() or not bad.sum():
        return float("inf")
    cost = good_cost * (good.sum() - np.cumsum(good) + good) + np.cumsum(bad) - bad
    best = np.flatnonzero(cost == cost.min())
    run = best[: 1 + np.flatnonzero(np.diff(best, append=best[-1] + 2) > 1)[0]]
    return float((run[0] + run[-1]) / 2 / bins)


FOLDS = 2


def known_labels(labels: DataFrame, fold: int = 0) -> DataFrame:
    """doc_id and quality of labels that have both, of one of two folds by id: thresholds are set on fold 0, and fold 1 is held out."""
    own = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return own.filter(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)) == fold)


def held_out(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """quality, kept, rows: how judged rows (doc_id, kept) fare by labels that no threshold was set on."""
    return judged.join(known_labels(labels, fold=1), "doc_id").groupBy("quality", "kept").agg(F.count("*").alias("rows"))


def failed_base() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_scores(stats: DataFrame, forests: list[Forest]) -> DataFrame:
    """stats without FEATURES, with score and base_failed; of several forests each row is scored by the one of its `part`."""
    fields = [f for f in stats.schema.fields if f.name not in FEATURES]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in FEATURES])
            part = batch.column("part").to_numpy() if len(forests) > 1 else np.zeros(len(x), int)
            score = np.zeros(len(x))
            for k, forest in enumerate(forests):
                score[part == k] = forest.scores(x[part == k])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], [*names, "score"])

    scored = stats.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "score double"]))
    return scored.withColumn("base_failed", failed_base())


#: Rows are calibrated in so many parts, each by a forest that grew from the others.
PARTS = 4


def with_part(stats: DataFrame) -> DataFrame:
    """Rows with equal statistics are in one part."""
    return stats.withColumn("part", F.pmod(F.xxhash64(*FEATURES), F.lit(PARTS)))


def sampled(rows: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The features and parts of about `limit` different rows, chosen by hash; only those leave their partitions."""
    own = rows.select("doc_id", *FEATURES, "part")
    n = own.count()
    some = own if n <= limit else own.filter(F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(n)) < limit)
    x = some.select(*FEATURES, "part").distinct().toPandas().to_numpy(float)
    x = x[np.lexsort(x.T)]
    return x[:, :-1], x[:, -1]


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = 8192, good_cost: float = 20.0, trees: int = 128) -> tuple[Forest, float]:
    """The forest and the score from which it rejects, of the rule statistics of a whole table and labels of fold 0.

    A forest gives the rows that it grew from lower scores than others like them. So the threshold is set on scores of
    forests that the row took no part in.
    """
    labelled = cut(with_part(stats.join(known_labels(labels), "doc_id")), "labelled")
    rows, part = sampled(labelled.filter("quality = 1"), fit_rows)
    supervised = len(rows) >= 2
    rows, part = (rows, part) if supervised else sampled(with_part(stats), fit_rows)
    if not len(rows):
        return Forest(np.zeros((1, len(FEATURES))), np.zeros(len(FEATURES)), 1), float("inf")
    # of all rows: a statistic that only rare rows have must have a spread too
    spread = np.array(stats.agg(*(F.stddev_pop(f) for f in FEATURES)).first(), float)
    if not supervised:
        return Forest(rows, spread, trees), float("inf")
    others = [x if len(x) else rows for x in (rows[part != k] for k in range(PARTS))]
    # trees of as many rows each, since scores depend on that
    sample = min(256, *map(len, others))
    forest = Forest(rows, spread, trees, sample)
    scored = with_scores(labelled, [Forest(x, spread, trees, sample) for x in others])
    return forest, calibrate(scored.filter(~F.col("base_failed")).select("score", "quality"), good_cost)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the BASE counts, base_failed, score and kept of every row; fit_rows bounds the sample that grows the forest."""
    stats = cut(rule_statistics(docs), "rule-statistics")
    forest, top = fit(stats, labels, **options)
    scored = with_scores(stats, [forest]).select("doc_id", *BASE, "score", "base_failed")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(top)))


def keep_good(docs: DataFrame, labels: DataFrame, documents: DataFrame | None = None, **options) -> DataFrame:
    """The rows of docs that the rules keep, each judged by its own text where it is read: no row is moved or joined.

    The forest and its threshold are of `documents`, the whole table of which docs is what earlier stages left; so they
    don't depend on which labelled rows those stages kept.
    """
    forest, top = fit(cut(rule_statistics(docs if documents is None else documents), "rule-statistics"), labels, **options)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        base = dict(zip((*BASE, *FEATURES), (c.to_numpy(zero_copy_only=False) for c in statistic_columns(each_text(texts)))))
        failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
        return pa.array(~failed & (forest.scores(np.column_stack([base[f] for f in FEATURES])) < top))

    return docs.filter(good(F.col("text").cast("binary")))

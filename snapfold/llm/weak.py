"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Each labeller votes good, bad or not at all on the rule statistics of a text. The votes of all rows are counted by
pattern (at most 3 ** labellers patterns), and expectation-maximisation on those counts estimates how often each labeller
is right on good and on bad rows, without gold labels; the posterior of a row's votes by those accuracies is its training
label. A logistic scorer over hashed words and word shapes is trained on all rows, by L-BFGS rounds whose gradients Spark
sums over the table of features, and scores every whole text. Rows whose score is below a threshold are rejected; it is
calibrated on all labelled rows of one of two folds, a good one rejected weighing `good_cost` bad ones kept (0.5 without any).

Edge cases: null and blank texts have no features, score 0 and are rejected; repeated rows get equal results;
labels without id or quality are ignored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import Words, as_bytes, cut, mix64, parts, slices
from snapfold.llm.rules import BASE, FEATURES, STATS, calibrate, known_labels, statistic_columns

#: name: (votes bad if, votes good if); between the two, and on texts too short for it, a labeller does not vote.
LABELLERS = {
    "symbols": ("f_symbols > 0.15", "f_symbols < 0.03"),
    "upper": ("f_upper > 0.3", "f_upper < 0.1"),
    "marks": ("f_marks > 0.8", "f_marks > 0.05 and f_marks < 0.45"),
    "repeats": ("f_repeats > 0.4", "f_repeats < 0.1"),
    "stutter": ("f_stutter > 0.15", "f_stutter < 0.05"),
    "variety": ("n_words >= 20 and f_variety < 0.85", "n_words >= 20 and f_variety > 0.92"),
    "top_word": ("n_words >= 50 and f_top_word > 0.2", "n_words >= 50 and f_top_word < 0.12"),
    "word_length": ("n_words >= 20 and (f_word_length > 6.8 or f_word_length < 3.8)", "n_words >= 20 and f_word_length > 4.2 and f_word_length < 6.4"),
    "lines": ("n_words >= 20 and f_dup_lines > 0.3", "n_words >= 20 and f_dup_lines < 0.05"),
    "length": ("n_words < 3", "n_words >= 50"),
}


def vote_columns() -> list[Column]:
    return [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).alias(name) for name, (bad, good) in LABELLERS.items()]


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 500, prior: tuple = ((19.0, 1.0), (1.0, 1.0))) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of `good` for each pattern of votes; each labeller's accuracy where it votes, on good and on bad rows; and
    the share of good rows.

    A labeller that does not vote says nothing. Labellers look for different faults: so the first guess rests
    on the number of bad votes, and the prior (right and wrong votes on good rows, then on bad rows) is worth 20 votes that they seldom
    accuse good rows, and next to nothing on how many bad rows each of them finds. The rounds then weigh all votes.
    """
    p = np.array([0.9, 0.4, 0.1])[np.minimum(2, (votes == -1).sum(axis=1))]
    cast = votes != 0
    accuracy, share = np.full((2, votes.shape[1]), 0.5), 0.5
    for _ in range(rounds):
        share = (p @ counts + 1) / (counts.sum() + 2)
        for k, (vote, weight) in enumerate(((1, p * counts), (-1, (1 - p) * counts))):
            accuracy[k] = (weight @ (votes == vote) + prior[k][0]) / (weight @ cast + sum(prior[k]))
        good, bad = accuracy
        odds = np.log(share / (1 - share)) + (votes == 1) @ np.log(good / (1 - bad)) + (votes == -1) @ np.log((1 - good) / bad)
        before, p = p, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(p - before).max() < 1e-9:
            break
    return p, accuracy, share


_CLASS = np.zeros(256, np.uint64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[128:] = 4
for _b in b"#*$%&|<>":
    _CLASS[_b] = 5


def hashed_features(texts: list[bytes], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of texts: how many features each has, the features' numbers, and how many words have them.

    Half of the features are hashed words, half word shapes; `values` makes numbers of the counts.
    """
    for lo, hi in slices(texts):
        w = Words(texts[lo:hi])
        with np.errstate(over="ignore"):
            again = np.zeros(len(w.hash), np.uint64)
            again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
            size = np.minimum(w.end - w.start, 15).astype(np.uint64)
            shape = mix64((((_CLASS[w.buf[w.start]] * np.uint64(8) + _CLASS[w.buf[w.end - 1]]) * np.uint64(16) + size) * np.uint64(2) + again) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        half = np.uint64(dims // 2)
        base = w.text * dims
        at = np.concatenate([base + (w.hash % half).astype(np.int64), base + (half + shape % half).astype(np.int64)])
        counts = np.bincount(at, minlength=(hi - lo) * dims)
        at = np.flatnonzero(counts)
        yield np.bincount(at // dims, minlength=hi - lo), at % dims, counts[at]


@dataclass
class Rows:
    """Rows of features: row of each entry, its feature and value; n rows."""

    n: int
    row: np.ndarray
    at: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(size: np.ndarray, at: np.ndarray, counts: np.ndarray) -> Rows:
        """Square roots of the shares of words that have a feature; each word has two."""
        row = np.repeat(np.arange(len(size)), size)
        words = np.bincount(row, weights=counts, minlength=len(size)) / 2
        return Rows(len(size), row, at, np.sqrt(counts / words[row]))

    def linear(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.x * w[self.at], minlength=self.n) + w[-1]

    def loss(self, good: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Gradient of the summed logistic loss for soft labels, by weight and intercept; then the loss."""
        z = self.linear(w)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good)
        g = np.bincount(self.at, weights=e[self.row] * self.x, minlength=len(w) - 1)
        return np.concatenate([g, [e.sum(), weight @ (np.logaddexp(0, z) - good * z)]])

    def scores(self, w: np.ndarray) -> np.ndarray:
        """The scorer's probability of good for each row; 0 for one without features."""
        p = 1 / (1 + np.exp(-np.clip(self.linear(w), -50, 50)))
        return np.where(np.bincount(self.row, minlength=self.n) > 0, p, 0.0)


def minimise(loss: Callable[[np.ndarray], np.ndarray], size: int, decay: float = 1e-4, rounds: int = 200, memory: int = 10, close: float = 1e-6) -> np.ndarray:
    """L-BFGS on a convex loss (its gradient, then its value) and a penalty on all weights but the last, until a round gains
    less than `close` of the value."""

    def whole(w: np.ndarray) -> tuple[np.ndarray, float]:
        g = loss(w)
        own = np.append(decay * w[:-1], 0.0)
        return g[:-1] + own, float(g[-1] + own @ w / 2)

    w = np.zeros(size)
    g, value = whole(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, used = -g, []
        for s, y in reversed(steps):
            used.append((s @ d) / (s @ y))
            d = d - used[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(used)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, t = float(g @ d), 1.0
        if slope > -1e-15:
            break
        while True:
            g2, value2 = whole(w + t * d)
            if value2 <= value + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        if value2 > value:
            break
        if (g2 - g) @ d > 0:
            steps = [*steps, (t * d, g2 - g)][-memory:]
        gain, w, g, value = value - value2, w + t * d, g2, value2
        if gain <= close * abs(value):
            break
    return w


def train(x: np.ndarray, good: np.ndarray, **options) -> np.ndarray:
    """Logistic weights (last: intercept) for soft labels of rows at hand, both classes weighing the same."""
    row, at = np.nonzero(x)
    rows = Rows(len(x), row, at, x[row, at].astype(float))
    weight = np.where(good >= 0.5, *class_weights((good >= 0.5).sum(), (good < 0.5).sum()))
    return minimise(lambda w: rows.loss(good, weight, w), x.shape[1] + 1, **options)


def class_weights(good: float, bad: float) -> tuple[float, float]:
    return 0.5 / max(1, good), 0.5 / max(1, bad)


def hashed(texts: list[bytes], linear: np.ndarray) -> np.ndarray:
    """The scorer's probability of good for each text; 0 for a text without words."""
    return np.concatenate([Rows.of(*f).scores(linear) for f in hashed_features(texts, len(linear) - 1)] or [np.zeros(0)])


@dataclass
class Model:
    """votes: table of patterns of votes and features by row; codes, posterior: of the patterns; accuracy: of each labeller
    on good and bad rows; share: of good rows; counts: rows by pattern."""

    votes: DataFrame
    codes: np.ndarray
    posterior: np.ndarray
    accuracy: dict[str, tuple[float, float]]
    share: float
    counts: np.ndarray
    dims: int

    def posteriors(self, codes: pa.Array) -> np.ndarray:
        return self.posterior[np.searchsorted(self.codes, codes.to_numpy(zero_copy_only=False))]


def learn(docs: DataFrame, dims: int = 2048) -> Model:
    """Votes and features of all rows, from one pass over their texts, and the accuracies fitted on all votes without labels."""
    names = list(LABELLERS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, whole.column(1))):
            texts, at, n = as_bytes(batch.column(1)), [], []
            for size, a, c in hashed_features(texts, dims):
                ends = np.cumsum(size)
                for lo, hi in zip(ends - size, ends):
                    at.append(a[lo:hi].astype("<u4" if dims > 1 << 16 else "<u2").tobytes())
                    n.append(c[lo:hi].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *statistic_columns(texts), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["doc_id", *BASE, *FEATURES, "at", "n"])

    code = sum((v + 1) * 3**i for i, v in enumerate(vote_columns())).cast("int").alias("pattern")
    votes = cut(rows.mapInArrow(read, f"{STATS}, at binary, n binary").select("doc_id", "n_words", code, "at", "n"), "votes")
    patterns = sorted(votes.groupBy("pattern").count().collect())  # at most 3 ** labellers
    codes, counts = np.array([r[0] for r in patterns], np.int64), np.array([r[1] for r in patterns], float)
    p, accuracy, share = np.zeros(0), np.zeros((2, len(names))), 0.5
    if patterns:
        p, accuracy, share = expectation_maximisation(codes[:, None] // 3 ** np.arange(len(names)) % 3 - 1, counts)
    return Model(votes, codes, p, {n: tuple(map(float, a)) for n, a in zip(names, accuracy.T)}, share, counts, dims)


def features(batch: pa.RecordBatch, dims: int) -> Rows:
    """Of a batch of `at` and `n`."""
    at, n = (b"".join(batch.column(c).to_pylist()) for c in ("at", "n"))
    size = np.array([len(x) for x in batch.column("n").to_pylist()], np.int64) // 4
    return Rows.of(size, np.frombuffer(at, "<u4" if dims > 1 << 16 else "<u2"), np.frombuffer(n, "<u4"))


def fit(model: Model, **options) -> np.ndarray:
    """The scorer's weights, trained on all rows: each round sums the gradient over the whole table of features, and one sum
    for each task (as many numbers as weights) passes the driver."""
    dims, good = model.dims, model.posterior >= 0.5
    if not model.counts.sum():
        return np.zeros(dims + 1)
    weights = class_weights(model.counts[good].sum(), model.counts[~good].sum())
    rows = model.votes.select("pattern", "at", "n")
    posteriors = replace(model, votes=None).posteriors

    def loss(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(dims + 2)
            for batch in batches:
                p = posteriors(batch.column("pattern"))
                total += features(batch, dims).loss(p, np.where(p >= 0.5, *weights), w)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        return sum(np.frombuffer(r[0]) for r in rows.mapInArrow(run, "total binary").collect())

    return minimise(loss, dims + 1, **options)


def scored_rows(model: Model, linear: np.ndarray) -> DataFrame:
    """doc_id, n_words, posterior and score of every row, from its features."""
    posteriors, dims = replace(model, votes=None).posteriors, model.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = pa.array(posteriors(batch.column("pattern"))), pa.array(features(batch, dims).scores(linear))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *columns], ["doc_id", "n_words", "posterior", "score"])

    return cut(model.votes.mapInArrow(run, "doc_id long, n_words long, posterior double, score double"), "scores")


def least_score(scored: DataFrame, good_cost: float) -> float:
    """The score above which rows are kept, by scored labelled rows (score, quality); 0.5 without any."""
    top = calibrate(scored.select((1 - F.col("score")).alias("score"), "quality"), good_cost)
    return 0.5 if top == float("inf") else 1 - top


def judged(docs: DataFrame, labels: DataFrame, good_cost: float, **options) -> tuple[DataFrame, np.ndarray, float]:
    """scored_rows of docs, the scorer's weights, and the score above which rows are kept."""
    model = learn(docs, **options)
    linear = fit(model)
    scored = scored_rows(model, linear)
    return scored, linear, least_score(scored.join(known_labels(labels), "doc_id"), good_cost)


def classify(docs: DataFrame, labels: DataFrame, good_cost: float = 20.0, **options) -> DataFrame:
    """doc_id, n_words, posterior (of the votes), score (of the scorer, 1: good) and kept of every row."""
    scored, _, least = judged(docs, labels, good_cost, **options)
    return scored.withColumn("kept", F.col("score") > F.lit(least))


def labellers(docs: DataFrame, **options) -> DataFrame:
    """labeller, good_accuracy, bad_accuracy: how often each is right where it votes, as estimated without labels."""
    model = learn(docs, **options)
    return docs.sparkSession.createDataFrame([(n, *a) for n, a in model.accuracy.items()], "labeller string, good_accuracy double, bad_accuracy double")


def keep_good(docs: DataFrame, labels: DataFrame, good_cost: float = 20.0, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, each judged by its own text where it is read: no row is moved or joined."""
    _, linear, least = judged(docs, labels, good_cost, **options)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(hashed(as_bytes(run), linear) for run in parts(texts, texts))]))

    return docs.filter(score(F.col("text").cast("binary")) > F.lit(least))

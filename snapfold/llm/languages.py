"""Languages of documents that may mix several: expectation-maximisation over n-gram likelihoods, and a penalised choice of set.

Each language is a distribution over hashed byte trigrams of words, counted over all documents to learn from. A document is a
mixture: each of its trigrams comes from one of its languages. Expectation-maximisation estimates the shares; the best
single language is the first of the set, then the others follow by their share among all, and the set grows while the
log-likelihood rises by more than `penalty` * log(number of trigrams) for a language more. The prediction is the language with
the largest share in the set, its score that share.

Counts are summed where they are read, then by language and cell; the model (CELLS counts for each language, at most
`most` languages, else an error) goes to each task. A text is read whole, and judged by itself.

Edge cases: a text that is null or has no letter is `und`, score 0, as is every text if nothing can be learned; rows whose id is
null are neither learned from nor held out; equal shares go to the language that comes first by code points; repeated rows
get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import as_bytes, slices

CELLS = 1 << 15
FOLDS = 5
#: Rounds that put languages in order; the shares of a set take more.
RANKING = 6
#: Letters in lower case; all other ASCII separates words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold() -> Column:
    """CRC-32 of the decimal id modulo FOLDS; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and cell of each trigram whose middle byte is in a word; edges of words count as blanks."""
    b = np.frombuffer(b" " + b" ".join(t.translate(_LETTERS) for t in texts) + b" ", np.uint8).astype(np.uint32)
    middle = np.flatnonzero(b[1:-1] != 32) + 1
    value = (b[middle - 1] << np.uint32(16)) | (b[middle] << np.uint32(8)) | b[middle + 1]
    cell = (value * np.uint32(2654435761)) >> np.uint32(32 - CELLS.bit_length() + 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(ends, middle - 1, side="right"), cell.astype(np.int64)


def counted(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below size, ascending, and how often each occurs."""
    if len(key) * 16 < size:
        return np.unique(key, return_counts=True)
    n = np.bincount(key, minlength=size)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class Model:
    """Languages in order, and for each of them the probability of each cell, and its logarithm."""

    names: list[str]
    p: np.ndarray
    log_p: np.ndarray


def model_of(names: list[str], counts: np.ndarray, smoothing: float = 0.5) -> Model:
    p = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    return Model(names, p.astype(np.float32), np.log(p))


def learn(docs: DataFrame, most: int = 400, smoothing: float = 0.5) -> Model:
    """The model of all texts with a language outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "cell", "n"])
            held.clear()

        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), as_bytes(batch.column(1))
            for lang in dict.fromkeys(langs.tolist()):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for lo, hi in slices(own):
                    cells = trigrams(own[lo:hi])[1]
                    held[lang] = held.get(lang, 0) + np.bincount(cells, minlength=CELLS)
                if len(held) > 64:
                    yield from flush()
        yield from flush()

    known = docs.filter((fold() != 0) & F.col("lang").isNotNull() & has_letter())
    texts = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    sums = texts.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("n")).select("lang", F.col("n.cell").alias("cell"), F.col("n.n").alias("n"))
    found = rows.limit(most + 1).toArrow().to_pylist()
    if len(found) > most:
        raise ValueError(f"over {most} languages: their model might not fit a task; raise `most` or clean the column")
    found.sort(key=lambda r: r["lang"])
    counts = np.zeros((len(found), CELLS))
    for own, r in zip(counts, found):
        own[np.array(r["cell"], np.int64)] = r["n"]
    return model_of([r["lang"] for r in found], counts, smoothing)


def shares(p: np.ndarray, n: np.ndarray, start: np.ndarray, total: np.ndarray, rounds: int, close: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages (rows of p) in each text and its log-likelihood under them, by expectation-maximisation.

    p: probabilities of the texts' distinct trigrams, 0 for languages left out; n: their counts; start: where texts begin.
    A text's rounds end when its own shares stand still.
    """
    there = np.add.reduceat(p, start, axis=1) > 0
    pi = (there / there.sum(axis=0)).astype(np.float32)
    p, n, total = p.astype(np.float32), n.astype(np.float32), total.astype(np.float32)
    text = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(n))))
    still = np.zeros(len(start), bool)
    for _ in range(rounds):
        w = p * pi[:, text]
        w *= n / w.sum(axis=0)
        new = np.where(still, pi, np.add.reduceat(w, start, axis=1) / total)
        still |= np.abs(new - pi).max(axis=0) < close
        pi = new
        if still.all():
            break
    return pi, np.add.reduceat(n * np.log((p * pi[:, text]).sum(axis=0, dtype=float)), start)


def some(keep: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the texts in `keep` (indices), and where those texts begin among them."""
    length = np.diff(np.append(start, size))[keep]
    begin = np.cumsum(length) - length
    return np.repeat(start[keep] - begin, length) + np.arange(length.sum()), begin


def judge(texts: list[bytes], model: Model, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which languages are in the set of each text, and their shares; both zero for a text without trigrams."""
    chosen, share = np.zeros((len(texts), len(model.names)), bool), np.zeros((len(texts), len(model.names)))
    text, cell = trigrams(texts)
    key, n = counted(text * CELLS + cell, len(texts) * CELLS)
    where = np.flatnonzero(np.diff(key // CELLS, prepend=-1))
    if not len(where) or not model.names:
        return chosen, share
    ids = (key // CELLS)[where]
    p, n = model.p[:, key % CELLS], n.astype(float)
    total = np.add.reduceat(n, where)
    single = np.add.reduceat(n * model.log_p[:, key % CELLS], where, axis=1)
    first, gain, each = single.argmax(axis=0), single.max(axis=0), np.arange(len(where))
    own = np.zeros((len(model.names), len(where)), bool)
    own[first, each] = True
    pi = own.astype(float)
    if len(model.names) > 1:
        rank = shares(p, n, where, total, RANKING)[0]
        rank[first, each] = 2
        order = np.argsort(-rank, axis=0, kind="stable")
        left = each
        for k in range(1, len(model.names)):
            rows, begin = some(left, where, len(n))
            wider = own[:, left].copy()
            wider[order[k, left], np.arange(len(left))] = True
            inside = np.repeat(wider, np.diff(np.append(begin, len(rows))), axis=1)
            now, likely = shares(p[:, rows] * inside, n[rows], begin, total[left], rounds)
            better = likely - gain[left] > penalty * np.log(total[left] + 1)
            left, now, wider, likely = left[better], now[:, better], wider[:, better], likely[better]
            own[:, left], pi[:, left], gain[left] = wider, now, likely
            if not len(left):
                break
    chosen[ids], share[ids] = own.T, pi.T
    return chosen, share


def predict(docs: DataFrame, model: Model, penalty: float = 3.0, rounds: int = 20, at_once: int = 64) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages (the set, largest share first) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            best, score, sets = [], [], []
            for a, b in slices(texts):
                for lo in range(a, b, at_once):
                    chosen, share = judge(texts[lo : min(b, lo + at_once)], model, penalty, rounds)
                    for own, x in zip(chosen, share):
                        order = [k for k in np.argsort(-x, kind="stable").tolist() if own[k]]
                        best.append(model.names[order[0]] if order else "und")
                        score.append(min(1.0, float(x[order[0]])) if order else 0.0)
                        sets.append(",".join(model.names[k] for k in order))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    shown = F.when(has_letter(), F.col("text").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), shown.alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learned and predicted on the same table, as the held-out fold says."""
    return predict(docs, learn(docs), **options)

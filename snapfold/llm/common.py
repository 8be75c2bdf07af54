"""Shared helpers: table access, reliable intermediate tables, and word tables of text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.shared import cut, scratch_path
from snapfold.shipping import ship

__all__ = ["WORD", "Words", "as_bytes", "cut", "each_text", "free_names", "load", "mix64", "parts", "scratch_path", "slices", "text_key"]

WORD = r"[^\x20\x09-\x0D]+"
_SEED = 0x9E3779B97F4A7C15


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key() -> Column:
    """128-bit digest of the text of a row; null counts as empty, as everywhere here."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a binary column; null becomes empty."""
    return [x if x is not None else b"" for x in column.to_pylist()]


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of texts of about `limit` bytes; a longer text is a run of its own."""
    lo = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text) + 1
    if texts:
        yield lo, len(texts)


def parts(rows: pa.RecordBatch | pa.Array, texts: pa.Array, limit: int = 1 << 20, most: int = 1024) -> Iterator:
    """rows in runs of about `limit` bytes of their texts and at most `most` rows, so that a worker never holds a whole
    batch a second time as Python objects; a longer text is a run of its own."""
    ends, lo = np.cumsum(np.append(0, pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))), 0
    while lo < len(rows):
        hi = min(lo + most, max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1))
        yield rows.slice(lo, hi - lo)
        lo = hi


def each_text(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a column of texts, which is read in short runs."""
    for run in parts(column, column):
        yield from as_bytes(run)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Of eight loaded bytes, those of a word with n left.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SHORT = 16


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a run of texts: byte buffer, start, end, text number and 64-bit hash of each.

    A word of up to 16 bytes is two numbers and its size, which name it exactly; of a longer one they are its XXH3.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        padded = joined + bytes(SHORT)
        self.buf = buf = np.frombuffer(padded, np.uint8)[: len(joined)]
        inside = np.ones(len(buf) + 1, bool)
        inside[0] = False
        np.logical_not(_SPACE[buf], out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.size = self.end - self.start
        self.text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1] if texts else np.zeros(0, int)
        self.counts = np.diff(np.searchsorted(self.start, np.append(self.text_start, len(buf))))
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        # eight bytes from any place on
        eight = np.ndarray(len(joined) + 1, "<u8", padded, strides=(1,)) if len(joined) else np.zeros(1, np.uint64)
        self.low = eight[self.start] & _FIRST[np.minimum(self.size, 8)]
        self.high = eight[np.minimum(self.start + 8, len(joined))] & _FIRST[np.clip(self.size - 8, 0, 8)]
        self.long = np.flatnonzero(self.size > SHORT)
        if len(self.long):
            import xxhash

            both = [xxhash.xxh3_128_intdigest(joined[i:j]) for i, j in zip(self.start[self.long].tolist(), self.end[self.long].tolist())]
            self.low[self.long] = np.array([x & (1 << 64) - 1 for x in both], np.uint64)
            self.high[self.long] = np.array([x >> 64 for x in both], np.uint64)
        with np.errstate(over="ignore"):
            self.hash = mix64(mix64(self.low * np.uint64(_SEED) + self.size.astype(np.uint64)) ^ self.high)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first place of each distinct word, and for every word its number among them.

        Words with equal hashes are held against each other by their bytes, so different words never count as one.
        """
        _, first, place = np.unique(self.hash, return_index=True, return_inverse=True)
        lead = first[place]
        same = (self.low == self.low[lead]) & (self.high == self.high[lead]) & (self.size == self.size[lead])
        if same.all() and all(lead[i] == i or self.word(i) == self.word(lead[i]) for i in self.long.tolist()):
            return first, place
        numbers: dict[bytes, int] = {}
        place = np.array([numbers.setdefault(self.word(i), len(numbers)) for i in range(len(self.start))], np.int64)
        return np.unique(place, return_index=True)[1], place

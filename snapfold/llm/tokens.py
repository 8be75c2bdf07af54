"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard is a file of frames: payload length (u64), masked CRC-32 of those eight bytes, payload, masked CRC-32 of the
payload, and a newline that closes the frame; all numbers are little-endian. A checksum is rotated and shifted by a
constant, so that one of data that itself holds checksums stays useful. A payload is a flag byte (bit 0: 32-bit ids
instead of 16-bit; bit 1: the document has no id), the document id (i64) and the ids. Shards are written by Spark's own
writer to any file system it knows, in ascending document order over shards and inside them. Shards are cut by size of
text, and an id that fills more than one is cut too, so that a shard fits a task. The index, a table with the place,
length and checksum of every record, is made by reading the shards back and written beside them.

Texts are encoded through a table of distinct lower-cased words, which is exact for this tokenizer: it lower-cases,
drops white space and never joins across it, and in plain words it splits letters, digits and other characters. Words
count as equal by their bytes alone.

Edge cases: a null or empty text is a record of the end id alone; rows without id come first; repeated rows are
repeated records, in an order that a rerun over the same files keeps; very long texts are one record; an empty table gives no shard and an empty
index; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from snapfold.llm.common import Words, as_bytes, cut, slices

MASK_SHIFT = 0xA282EAD8
HEAD = struct.Struct("<QI")
CRC = struct.Struct("<I")
#: Words of these characters split by the rule of _RUNS; they neither compose with each other nor lower-case specially.
_SIMPLE = re.compile("[\\x00-\\x7FÀ-ÖØ-öø-ÿ]*")
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_SHIFT) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + CRC.pack(masked(size)) + payload + CRC.pack(masked(payload)) + b"\n"


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of every frame; damage raises an error."""
    at = 0
    while at < len(data):
        size, crc = HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != crc:
            raise ValueError(f"damaged length at {at}")
        payload = data[at + 12 : at + 12 + size]
        if len(payload) != size or CRC.unpack_from(data, at + 12 + size)[0] != masked(payload) or data[at + 16 + size : at + 17 + size] != b"\n":
            raise ValueError(f"damaged record at {at}")
        yield at, payload
        at += 17 + size


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = ids.dtype.itemsize != 2
    return struct.pack("<Bq", wide | (doc_id is None) << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2", copy=False).tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & 2 else doc_id, np.frombuffer(payload, "<u4" if flags & 1 else "<u2", offset=9)


#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordTable:
    """Ids of words as bytes, kept for the first words met: mostly the frequent ones. The limits bound memory."""

    def __init__(self, path: str, words: int = 400_000, runs: int = 100_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.max_words, self.max_runs, self.words, self.runs = words, runs, {}, {}

    def whole(self, word: str) -> bytes:
        return array(self.code, self.tok.encode(word, add_special_tokens=False).ids).tobytes()

    def run(self, run: str) -> bytes:
        """Ids of one run of letters, one digit, or one run of other characters."""
        if (ids := self.runs.get(run)) is None:
            if run.isascii() and not run.isprintable():
                ids = self.whole(run)
            else:
                spelled = run if run.isascii() else "".join([_ALPHABET[b] for b in run.encode()])
                ids = array(self.code, [t.id for t in self.tokenize(spelled)]).tobytes()
            if len(self.runs) < self.max_runs:
                self.runs[run] = ids
        return ids

    def segment(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():
            # ASCII letters alone are one run
            ids = array(self.code, [t.id for t in self.tokenize(text.lower())]).tobytes()
        elif _SIMPLE.fullmatch(text) and "'" not in text and "<|" not in text:
            ids = b"".join(map(self.run, _RUNS.findall(text.lower())))
        else:
            ids = self.whole(text)
        if len(self.words) < self.max_words:
            self.words[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text: every distinct word of a run of texts is looked up once and joined back by position."""
        known, segment = self.words.get, self.segment
        for lo, hi in slices(texts):
            # lower-casing ASCII early is safe but for combining marks (lead bytes CC and CD), which may compose with a letter
            w = Words([t if b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts[lo:hi]])
            first, place = w.distinct()
            data = w.buf.tobytes()
            ids = [known(word) or segment(word) for word in (data[i:j] for i, j in zip(w.start[first].tolist(), w.end[first].tolist()))]
            size = np.array(list(map(len, ids)), np.int64) // self.dtype.itemsize
            flat, base = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size) - size
            each = size[place]
            ends = np.cumsum(each)
            out = flat[np.repeat(base[place] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
            counts = np.bincount(w.text, weights=each, minlength=hi - lo).astype(np.int64)
            at = 0
            for n in counts.tolist():
                yield out[at : at + n]
                at += n


_tables: dict[str, WordTable] = {}


_LEAST = -(1 << 63)


def shard_cuts(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """Ids between shards, of sizes (at, size): a row counts once, and once more for every quarter of the average that it holds.

    An id that fills several shards occurs as often as it ends one.
    """
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-(total[0] + 64 * total[1]) // shard_bytes))
    if shards == 1:
        return []
    step = max(64, total[0] // (4 * max(1, total[1])))
    points = sizes.select("at", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / step).cast("int"))).alias("i"))
    return sorted(points.agg(F.percentile_approx("at", [i / shards for i in range(1, shards)], max(10_000, 100 * shards))).first()[0])


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_bytes: int = 12 << 20) -> DataFrame:
    """Write docs (doc_id, text) as records under path/shards and the index under path/index; returns the index."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    at = F.coalesce(F.col("doc_id"), F.lit(_LEAST))
    # the ids between shards are few numbers, so each row knows its shard without the sampling pass of a range shuffle
    cuts = np.array(shard_cuts(cut(rows.select(at.alias("at"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "sizes"), shard_bytes), np.int64)

    @F.arrow_udf("int")
    def shard(at: pa.Array, spread: pa.Array) -> pa.Array:
        low, high = (np.searchsorted(cuts, at.to_numpy(zero_copy_only=False), side) for side in ("left", "right"))
        return pa.array((low + (spread.to_numpy(zero_copy_only=False) * (high - low + 1) >> 20)).astype(np.int32))

    # rows of one id are told apart by text and place in the table, so that an id of any size is cut too
    spread = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 20))
    dealt = rows.withColumn("spread", spread).withColumn("shard", shard(at, F.col("spread")))
    placed = dealt.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "spread").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tables:
            _tables[tokenizer] = WordTable(tokenizer)
        table = _tables[tokenizer]
        tail = np.array([end_id], table.dtype)
        for batch in batches:
            out, size, texts = [], 0, as_bytes(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), table.encode(texts)):
                out.append(frame(pack(doc_id, np.concatenate([ids, tail])))[:-1])
                size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # the text writer puts out a value's bytes as they are, then the newline that closes the frame
    placed.mapInArrow(encode, "value binary").select(F.col("value").cast("string")).write.option("compression", "none").text(f"{path}/shards")
    # the index is what reading the files back gives, with all checksums compared
    read_records(spark, path).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, from the shards: doc_id, shard, offset, bytes, position in the shard, number of ids,
    ids of the shard before it, and the CRC-32 of its ids as unsigned 32-bit integers."""
    schema = "doc_id long, shard int, offset long, bytes long, position long, n_tokens long, before long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(f"{path}/shards").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, before = [], 0
                for i, (at, payload) in enumerate(frames(data.as_py())):
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, shard, at, len(payload) + 17, i, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                columns = list(zip(*rows)) or [[]] * 8
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])

    return files.mapInArrow(parse, schema)


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the rows of `wanted` (doc_id, shard, offset, bytes; rows of the index in any order), grouped by
    shard so that each file is opened once."""
    files = spark.read.format("binaryFile").load(f"{path}/shards").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")
    places = wanted.groupBy("shard").agg(F.collect_list(F.struct("offset", "bytes")).alias("places"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for places, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                got += [unpack(p) for x in places for _, p in frames(data[x["offset"] : x["offset"] + x["bytes"]])]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tolist() for g in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return places.join(files, "shard").select("places", "content").mapInArrow(parse, "doc_id long, ids array<long>")


def token_starts(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: `start` counts the ids of all records before, over all shards."""
    # one row for each shard, already summed; rows themselves never meet in one task
    shards = records.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    first = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    return records.join(first, "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

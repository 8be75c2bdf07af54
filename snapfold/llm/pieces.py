"""SentencePiece encoding and decoding with a table of distinct chunks.

A BPE model whose pieces never hold a white-space marker after another character cannot merge across the start of a
marked word. So a text is the concatenation of chunks (markers, then other characters), and each worker segments every
distinct chunk once, keeps ids, their decimal text and the decoded text in a table of bounded size, and joins them back
by position. The model is checked for that property, and a text is encoded whole where it does not hold.

Edge cases: null and empty texts give the end id alone and decode to the empty string; a literal marker character in a
text acts as a space, as in the library; very long texts are done whole; repeated rows give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


class ChunkTable:
    """Segments texts by one model; `limit` bounds the number of chunks that are kept."""

    def __init__(self, model: str, limit: int = 100_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.limit, self.table = limit, {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = re.compile(f"[^{MARK}]{MARK}")
        self.end = self.sp.eos_id()
        # the scheme also needs the dummy marker in front and all other spaces kept as they are
        plain = self.sp.decode(self.sp.encode("  a  b ")) == "  a  b " and self.sp.encode("a", out_type=str)[0].startswith(MARK)
        self.whole = not plain or any(crossing.search(p) for p in pieces)

    def segment(self, chunks: list[str]) -> dict[str, tuple[int, str, str]]:
        """Count of ids, decimal ids and decoded text by chunk; each chunk starts with the space of its first marker."""
        ids = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if len(c) == 1:
                ids[i] = [self.sp.piece_to_id(MARK)]
        said = self.sp.decode(ids, num_threads=1)
        # the library strips the first marker's space in front of a text; inside a text it stays
        return {c: (len(x), " ".join(map(str, x)), c if d == c[1:] or d == c else " " + d) for c, x, d in zip(chunks, ids, said)}

    def chunks(self, text: str) -> list[str]:
        marked = " " + text.replace(MARK, " ")
        if "  " in marked or marked[-1] == " ":
            return _CHUNK.findall(marked) if text else []
        return (" " + marked[1:].replace(" ", "\0 ")).split("\0") if "\0" not in marked else _CHUNK.findall(marked)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids with the end id, ids as decimal text, decoded text."""
        if self.whole:
            for text in texts:
                ids = [*self.sp.encode(text), self.end]
                yield len(ids), " ".join(map(str, ids)), self.sp.decode(ids)
            return
        parts, table = [self.chunks(t) for t in texts], self.table
        missing = [c for c in set().union(*parts) if c not in table]
        more = self.segment(missing) if missing else {}
        # chunks seen first are mostly the frequent ones: a full table keeps those and segments others for each run of texts
        if len(table) + len(more) <= self.limit:
            table.update(more)
            more = table
        for chunks in parts:
            found = [table.get(c) or more[c] for c in chunks]
            counts, ids, said = zip(*found) if found else ((), (), ())
            yield sum(counts) + 1, " ".join([*ids, str(self.end)]), "".join(said)[1:]


_tables: dict[str, ChunkTable] = {}


def _table(model: str) -> ChunkTable:
    """One table for each worker and model; it outlives the task."""
    if model not in _tables:
        _tables[model] = ChunkTable(model)
    return _tables[model]


def _encoded(batch: pa.RecordBatch, model: str) -> Iterator[tuple[int, str, str]]:
    texts = [t or "" for t in batch.column(1).to_pylist()]
    table, lo, size = _table(model), 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > 1_000_000 or i == len(texts) - 1:
            yield from table.digests(texts[lo : i + 1])
            lo, size = i + 1, 0


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text, by the model file at path `model`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids, decoded = [], [], []
            for n, as_text, said in _encoded(batch, model):
                counts.append(n)
                ids.append(hashlib.sha256(as_text.encode()).hexdigest())
                decoded.append(hashlib.sha256(said.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def piece_ids(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids (with the end id) and decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                counts, ids, said = [0], [], []
                for n, as_text, decoded in _encoded(part, model):
                    counts.append(counts[-1] + n)
                    ids.append(np.fromstring(as_text, np.int32, sep=" "))
                    said.append(decoded)
                rows = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(counts), pa.int64()), rows, pa.array(said, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")

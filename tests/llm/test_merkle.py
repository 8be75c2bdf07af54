"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from snapfold.llm import merkle


def digest(*parts):
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(row):
    fields = [None if row[c] is None else str(row[c]).encode() for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return digest(*(b"-" if v is None else b"%d:%s" % (len(v), v) for v in fields))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append((level[run:i], level[i + 1 : run + 3]))
        i //= 3
    return out


def plain(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s, members in sources.items():
        members.sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in members])
    top = tree([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, (_, _, own, row) in enumerate(sources[s]):
            sides = path(trees[s], i) + path(top, k)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None:
                row = row | {"text": row["text"].replace("\n", "")}
            now = leaf(row)
            for left, right in sides:
                now = digest(*left, now, *right)
            proof = hashlib.sha256(b"".join(b"".join(a) + b"".join(b) for a, b in sides)).hexdigest()
            yield row["doc_id"], own.decode(), trees[s][-1][0].decode(), top[-1][0].decode(), proof, now.decode(), now == top[-1][0]


def table(spark, rows):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    return spark.createDataFrame([tuple(r) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").select(*names, F.lit(1).alias("pos"), F.lit("x").alias("node"), F.lit(0).alias("block"))


def check(spark, rows, depth):
    docs = table(spark, rows)
    got = sorted(map(repr, map(tuple, merkle.manifest(docs, depth).collect())))
    assert got == sorted(map(repr, plain([r.asDict() for r in docs.collect()])))


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_with_rounds(spark, depth):
    rows = [(i, f"s{i % 2}" if i % 5 else "hot", "en", i, f"line {i}\nmore\n") for i in range(100)]
    rows += [(None, None, None, None, None), (None, None, "en", 1, ""), (7, "alone", "é", 0, "ü\n"), (8, "s1", None, None, None), (8, "s1", None, None, None), (9, "", "x", 1, "\n\n"), (10**12, "hot", "en", 3, "日本\n")]
    check(spark, rows, depth)


def test_one_row_one_source_and_none(spark):
    check(spark, [(5, "a", "en", 1, "x\ny")], 6)
    check(spark, [(i, None, None, None, None) for i in range(4)], 6)
    assert merkle.manifest(table(spark, []), 6).count() == 0

"""Phrase collocations against counts of all n-grams in plain Python."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapfold.llm import phrases

SCHEMA = "doc_id long, lang string, text string"


def plain(rows, longest=5, least=100, covered=100, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for lang, f in counts.items():
        good = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        out = []
        for g, a in good.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and inside(g, h) for h, b in good.items()):
                continue
            score, _, x, y = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            out.append((-score, -a, " ".join(g).encode(), x, y))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(out)[:top], 1):
            yield lang, rank, phrase.decode(), -a, x, y, total[lang], -score


def text(rnd, n):
    words = ["The", "the", "of", "New York", "new york City", "a.b", "é", "É", "日本 語", "x" * 40, "x" * 39 + "y", "mit\tlicense", "out", "of the", "\u00a0"]
    return "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", ", ", "\n", "\t"]) for _ in range(n))


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).withColumns({"block": F.lit(1), "gram": F.lit("x"), "n": F.lit(2)})
    got = sorted(map(tuple, phrases.collocations(docs.repartition(3), **options).collect()))
    want = sorted(plain(rows, **{k: v for k, v in options.items() if k not in ("block_bytes", "share")}))
    assert got == want
    return got


@pytest.mark.parametrize("options", [{"least": 8}, {"least": 8, "block_bytes": 300, "share": 2}, {"least": 15, "covered": 80, "top": 10}, {"least": 10, "longest": 3}])
def test_phrases_against_all_ngrams(spark, options):
    rnd = random.Random(5)
    rows = [(rnd.choice(["en", "en", "fr", None]), text(rnd, rnd.randint(0, 40))) for _ in range(120)]
    rows += [("en", "one two three four five six")] * 20 + [("de", None), (None, ""), ("fr", " . , "), ("en", text(rnd, 600))]
    assert len(check(spark, rows, **options)) > 10


def test_nothing(spark):
    check(spark, [(None, None), ("en", " .\n")], least=2)
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", "a b c", 4 * 10**12, [9 * 10**12, 5 * 10**12, 4 * 10**12], [8 * 10**12, 6 * 10**12, 4 * 10**12])], "lang string, phrase string, a long, lead array<long>, rear array<long>")
    got = phrases.scored(grams, spark.createDataFrame([("en", 10**13)], "lang string, n long"), 3).first()
    want = min((1000 * 4 * 10**12 * 10**13 // (x * y), k) for k, (x, y) in enumerate([(9 * 10**12, 6 * 10**12), (5 * 10**12, 8 * 10**12)]))
    assert got["score"] == want[0]


def test_stripes_merge_and_packing_is_exact(spark):
    x = np.array([0, 1, 255, 256, 2**32 - 1, 7])
    assert (phrases.unpacked(phrases.packed(x)) == x).all() and len(phrases.unpacked(phrases.packed(x[:0]))) == 0
    prefix, after, n = np.array([10, 10, 10, 11, 10]), np.array([4, 5, 6, 6, 6]), np.array([1, 2, 3, 9, 4])
    start, first = np.array([0, 3, 4]), np.array([0, 3, 4])
    column = phrases.stripe_bytes(after, n, start, first)
    got = phrases.from_stripes(column.slice(1, 2), np.array([1, 1]))
    assert got[0].tolist() == [6, 6] and got[1].tolist() == [9, 4]
    rows = [(7, 1, [10], [3]), (8, 2, [11], [1]), (7, 2, [10], [1])]
    each = spark.createDataFrame([(*r, bytes(c)) for r, c in zip(rows, column.to_pylist())], "bundle long, block long, prefix array<long>, size array<long>, stripe binary")
    stripe = phrases.merged(each, 5, at_once=1)
    assert sorted((r["prefix"], r["after"], r["a"]) for r in phrases.said(stripe, 1).collect()) == [(10, 6, 7), (11, 6, 9)]
    assert sorted((r["prefix"], r["a"]) for r in phrases.said(stripe, 2).collect()) == [(10, 7), (11, 9)]
    told = [(r["block"], p, x) for r in stripe.filter("kind = 0").collect() for p, x in zip(r["prefix"], r["after"])]
    assert sorted(told) == [(1, 10, 6), (2, 10, 6), (2, 11, 6)]


def test_numbers_of_any_size_in_seven_bits():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 2**62])
    data, size = phrases.varints(x)
    assert (phrases.from_varints(data) == x).all() and size.tolist() == [1, 1, 1, 2, 2, 3, 6, 9]


def test_rows_of_stripes_grow_as_the_input(spark, monkeypatch):
    """A block sends no more rows when there are more blocks; a row for each share of all words would be more and more."""

    class Counted(Exception):
        pass

    def merged(each, *options, **more):
        raise Counted(max(r["count"] for r in each.groupBy("block").count().collect()))

    monkeypatch.setattr(phrases, "merged", merged)
    rnd = random.Random(2)
    texts = [(None, "en", text(rnd, 40)) for _ in range(60)]
    for times in (1, 4):
        with pytest.raises(Counted) as rows:
            phrases.collocations(spark.createDataFrame(texts * times, SCHEMA).repartition(2), least=8, block_bytes=1000, share=60)
        assert rows.value.args[0] <= phrases.wide(spark.range(1))


def test_stripes_are_cut_by_counts_and_merged_as_they_pass(spark):
    words = np.arange(1, 8) * 10
    rnd = np.random.default_rng(3)
    states, want = [], Counter()
    for block in range(3):
        gram = rnd.integers(0, 7, 400)
        states.append(phrases.state_row(block, "en", np.arange(400), gram, None, words, np.full(7, 60), words))
        want.update(zip(words[gram[:-1]].tolist(), words[gram[1:]].tolist()))
    given = spark.createDataFrame(pa.concat_tables(states))
    each = phrases.stripes(given, 1000, 2, 3)
    assert max(sum(r["size"]) for r in each.collect()) == 3 and each.count() > 3 * 2
    for at_once in (1, 20, 10**6):
        got = {(r["prefix"], r["after"]): r["a"] for r in phrases.said(phrases.merged(each, 20, at_once=at_once, bundles=2), 1).collect()}
        assert got == {k: a for k, a in want.items() if a >= 20}


def test_memory_of_a_block(spark, monkeypatch):
    """Words are told apart in runs of texts, so a block takes a few times its bytes."""

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(phrases, "TaskContext", Task)
    texts = [b" ".join(b"w%d" % (i * j % 997) for j in range(3_000)) for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts, pa.binary())], ["lang", "text"])
    tracemalloc.start()
    (block,) = phrases.blocks(Docs(), 1 << 30)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(block.column("counts")[0].as_py()) == 3_000 * len(texts)
    assert peak < 12 * sum(map(len, texts))

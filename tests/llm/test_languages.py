"""Language mixtures: shares against plain rounds, sets, held-out accuracy, and rows that nothing is known of."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapfold.llm import languages

SYLLABLES = {"aa": ["ka", "ro", "mi", "ten"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["ção", "que", "los", "é"]}
SCHEMA = "doc_id long, text string, lang string"


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    counts = np.array([np.bincount(languages.trigrams([prose(rnd, k, 3000).encode()])[1], minlength=languages.CELLS) for k in sorted(SYLLABLES)])
    return languages.model_of(sorted(SYLLABLES), counts)


def plain_shares(text, model, rounds):
    cells = languages.trigrams([text])[1]
    pi = np.full(len(model.names), 1 / len(model.names))
    for _ in range(rounds):
        new = np.mean([pi * model.p[:, c] / (pi * model.p[:, c]).sum() for c in cells], axis=0)
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    return pi


def test_shares_as_plain_rounds(model):
    rnd = random.Random(2)
    texts = [(prose(rnd, "aa", a) + " " + prose(rnd, "bb", b)).encode() for a, b in ((40, 0), (30, 30), (5, 60))]
    text, cell = languages.trigrams(texts)
    key, n = languages.counted(text * languages.CELLS + cell, len(texts) * languages.CELLS)
    start = np.flatnonzero(np.diff(key // languages.CELLS, prepend=-1))
    got, _ = languages.shares(model.p[:, key % languages.CELLS], n, start, np.add.reduceat(n, start), 20)
    for k, t in enumerate(texts):
        assert np.allclose(got[:, k], plain_shares(t, model, 20), atol=2e-3)


def test_sets_and_neighbours(model):
    rnd = random.Random(3)
    texts = [prose(rnd, "aa", 200), prose(rnd, "bb", 150) + " " + prose(rnd, "cc", 50), "", "123 !!", prose(rnd, "cc", 1), prose(rnd, "aa", 100) + prose(rnd, "bb", 90) + " " + prose(rnd, "cc", 80)]
    texts = [t.encode() for t in texts]
    chosen, share = languages.judge(texts, model, 3.0, 20)
    assert chosen.tolist()[:4] == [[True, False, False], [False, True, True], [False] * 3, [False] * 3] and chosen[5].all()
    assert 0.6 < share[1, 1] < 0.9 and np.allclose(share.sum(axis=1)[[0, 1, 4, 5]], 1, atol=1e-3)
    # a text's result does not depend on those beside it
    for k, t in enumerate(texts):
        assert np.array_equal(languages.judge([t], model, 3.0, 20)[1][0], share[k])


def test_held_out_rows(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, lang, rnd.randint(3, 60)), None if i % 17 == 0 else lang) for i in range(600) for lang in [rnd.choice(sorted(SYLLABLES))]]
    truth = {i: rnd for i, _, rnd in rows}
    rows += [(9000, None, "aa"), (9001, "", "bb"), (9002, "12 %% 3", "cc"), (None, prose(rnd, "aa", 30), "bb"), (9003, "x", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"cell": F.lit(1), "n": F.lit("x"), "score": F.lit(2.0), "held_out": F.lit(1)})
    got = languages.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by_id.items())
    out = [i for i, lang in truth.items() if by_id[i]["held_out"] and lang]
    assert len(out) > 80 and sum(by_id[i]["lang_pred"] == truth[i] for i in out) / len(out) > 0.98
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (9000, 9001, 9002))
    assert by_id[None]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got)
    # held-out labels and ids take no part
    other = spark.createDataFrame([(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows], SCHEMA)
    assert sorted(map(repr, languages.identify(other).collect())) == sorted(map(repr, got))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in languages.identify(docs).collect()} == {("und", 0.0)}
    assert languages.identify(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="languages"):
        languages.learn(spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], SCHEMA), most=1)

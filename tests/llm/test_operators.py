"""Each operator against brute force or an exact round trip, and on nulls, empty texts, repeats, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapfold.llm import backoff, chat, licences, mixing, pieces, rules, similar, simhash, tokens, topk, weak
from snapfold.llm.common import scratch_path
from snapfold.llm.queries import op6_top_k, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RND = random.Random(7)
VOCAB = [f"w{i}" for i in range(60)] + ["the", "MIT", "License", "é", "日本", "a|b", "!!"]
#: doc_id, text, source, and columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size long, block long, score double, component_id string, kept string"


def sentence(n):
    return " ".join(RND.choice(VOCAB) for _ in range(n))


@pytest.fixture(autouse=True)
def own_draws():
    """Each test draws the same, whatever ran before."""
    RND.seed(11)


@pytest.fixture(scope="module")
def rows():
    RND.seed(7)
    out = [(i, sentence(RND.randint(1, 80)), f"s{i % 3}") for i in range(60)]
    out += [(100, None, "s0"), (101, "", None), (102, " \n\t ", None), (103, sentence(4000), "s1"), (104, "one", "s2"), (105, "one two", None)]
    out += [(106, out[0][1], "s0"), (107, out[0][1] + " extra", "s1"), (8, out[8][1], out[8][2])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None, 1, 2, 0.5, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, _, _ in rows[:60]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_mixing_meets_targets_and_reruns_agree(spark, docs, rows):
    got = mixing.mix(docs, block_rows=8).toPandas()
    again = mixing.mix(docs, block_rows=8).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    want = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    assert all(want[i] == s for i, s in zip(got["doc_id"], got["size"]))
    sums = got.groupby("source", dropna=False).agg(t=("target", "first"), k=("taken", "sum"), s=("size", "sum"), big=("size", "max"))
    assert math.isclose(sums["t"].sum(), 1.5 * sums["s"].sum())
    assert ((sums["t"] - sums["k"]).abs() <= 40 + sums["big"].where(sums["big"] > 1000, 0)).all()


def test_flight_keeps_balance():
    p, size, rng = np.full(500, 0.3), np.random.default_rng(1).integers(1, 900, 500), np.random.default_rng(2)
    q = mixing.flight(p, size, rng, 6)
    assert ((q > 0) & (q < 1)).sum() <= 8
    assert math.isclose(q.sum(), p.sum(), abs_tol=1e-6) and math.isclose(q @ size, p @ size, abs_tol=1e-4)


def test_mixed_rows_repeat_whole_rows(docs):
    decided = {(r["doc_id"], r["source"]): 0 for r in docs.select("doc_id", "source").collect()}
    for r in mixing.mix(docs).collect():
        decided[r["doc_id"], r["source"]] += r["copies"]
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["source"]) for r in got.collect()) == Counter({k: n for k, n in decided.items() if n})


def test_rows_alike_fill_several_blocks(spark):
    rows = [(7, "a b c", "s")] * 90 + [(None, "a b", "s")] * 90 + [(i, "a", "s") for i in range(20)]
    sizes = mixing.sizes_of(frame(spark, rows)).withColumn("blocks", mixing.F.lit(16))
    blocks = mixing.in_blocks(sizes, block_rows=8).groupBy("doc_id", "block").count().collect()
    assert all(len([1 for r in blocks if r["doc_id"] == i]) > 8 for i in (7, None)) and max(r["count"] for r in blocks) < 30
    got = mixing.mix(frame(spark, rows), block_rows=8).collect()
    assert len(got) == 200 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 3


NAMES = ("_id", "copies", "_turn", "_row", "_size", "_text", "_key", "_text_key", "kept_id", "own_key", "mix_row", "nth", "row", "label", "Kept_Rows")


def test_stages_keep_columns_of_any_name(spark, docs, labels):
    named = docs
    for i, c in enumerate(NAMES):
        named = named.withColumn(c, mixing.F.lit(700 + i))
    for stage in (mixing.mixed_rows, simhash.keep_one, similar.keep_one, lambda d: rules.keep_good(d, labels), lambda d: weak.keep_good(d, labels)):
        got = stage(named)
        assert got.columns == named.columns
        assert all([r[c] for c in NAMES] == list(range(700, 700 + len(NAMES))) for r in got.collect())


def test_rule_statistics(docs, rows, labels):
    text = {i: t or "" for i, t, _ in rows}
    got = rules.quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        t = text[r["doc_id"]]
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed)
        assert not (failed and r["kept"])


def test_forest_isolates_far_rows():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2000, 4))
    far = rng.normal(size=(50, 4)) + np.array([0, 9, 0, 0])
    forest = rules.Forest(rows, rows.std(axis=0))
    assert np.quantile(forest.scores(rows), 0.99) < forest.scores(far).min()


def test_rules_without_labels_keep_all_but_base(docs, labels):
    got = rules.quality_rules(docs, labels.filter("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)


def test_spread_is_of_all_rows(spark):
    prose = lambda n: " ".join("".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 9))) for _ in range(n))
    data = [(i, prose(60), "s") for i in range(400)]
    data += [(1000 + i, " ".join(f"{w}%#" for w in prose(60).split()), "s") for i in range(6)]
    stats = rules.rule_statistics(frame(spark, data))
    forest, _ = rules.fit(stats, spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int"), fit_rows=100)
    want = stats.select(*rules.FEATURES).toPandas().to_numpy().std(axis=0)
    assert np.allclose(forest.spread, want) and forest.spread[rules.FEATURES.index("f_symbols")] > 0
    assert (forest.feature == rules.FEATURES.index("f_symbols")).any()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_few_labels_keep_all_clean_rows(spark, seed):
    """The threshold is set on rows that did not grow the forest: their scores are those of other clean rows."""
    RND.seed(seed)
    prose = lambda n: " ".join("".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 9))) + RND.choice(["", "", "", ".", ","]) for _ in range(n))
    clean = [(i, prose(RND.randint(40, 160)), "s") for i in range(300)]
    junk = [(1000 + i, " ".join(w.upper() + "%%%" for w in prose(80).split()), "s") for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(1000 + i, 0) for i in range(20)], "doc_id long, quality int")
    assert rules.known_labels(labels).filter("quality = 1").count() < 40
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(frame(spark, clean + junk), labels).collect()}
    assert all(got[i] == (i < 1000) for i in got)


def test_forest_scores_as_plain_paths():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 3))
    forest = rules.Forest(rows, rows.std(axis=0), trees=16, sample=64)
    for x, got in zip(rows[:40], forest.scores(rows[:40])):
        paths = []
        for t in range(16):
            node = 0
            while forest.feature[t, node] >= 0:
                node = 2 * node + 1 + int(x[forest.feature[t, node]] > forest.cut[t, node])
            paths.append(forest.path[t, node])
        assert math.isclose(got, 2 ** (-sum(paths) / 16 / rules.mean_path(64)))


def test_threshold_costs_least(spark):
    rnd = random.Random(1)
    for cost in (1.0, 20.0):
        data = [(rnd.random() * 0.7 + 0.3 * (q == 0), q) for q in (0, 1) for _ in range(60)]
        top = rules.calibrate(spark.createDataFrame(data, "score double, quality int"), cost, bins=64)
        price = lambda t: sum(cost if q else 0 for x, q in data if int(x * 64) / 64 >= t) + sum(not q for x, q in data if int(x * 64) / 64 < t)
        assert price(top) == min(price(b / 64) for b in range(66))


def test_expectation_maximisation_against_rows():
    """Patterns with counts give what the same rounds over single rows give, and accuracies that votes were drawn by."""
    rng = np.random.default_rng(4)
    good = rng.random(6000) < 0.8
    right = np.array([[0.99, 0.97, 0.95, 0.98], [0.9, 0.8, 0.7, 0.6]])
    hit = rng.random((6000, 4)) < np.where(good[:, None], right[0], right[1])
    votes = np.where(hit, 1, -1) * np.where(good[:, None], 1, -1) * (rng.random((6000, 4)) < 0.9)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, accuracy, share = weak.expectation_maximisation(patterns, counts.astype(float))
    q = [(0.9, 0.4, 0.1)[min(2, v.count(-1))] for v in votes.tolist()]
    for _ in range(500):
        prior, acc = (sum(q) + 1) / 6002, []
        for cls in (1, -1):
            w = np.array([x if cls == 1 else 1 - x for x in q])
            a, b = (19, 20) if cls == 1 else (1, 2)
            acc.append([((w * (votes[:, j] == cls)).sum() + a) / ((w * (votes[:, j] != 0)).sum() + b) for j in range(4)])
        odds = np.full(6000, math.log(prior / (1 - prior)))
        for j in range(4):
            odds += np.where(votes[:, j] == 1, math.log(acc[0][j] / (1 - acc[1][j])), np.where(votes[:, j] == -1, math.log((1 - acc[0][j]) / acc[1][j]), 0))
        q = (1 / (1 + np.exp(-odds))).tolist()
    assert np.allclose(p[place.ravel()], q, atol=1e-6) and math.isclose(share, sum(q) / 6000, rel_tol=1e-3)
    assert np.abs(accuracy[0] - right[0]).max() < 0.03 and np.abs(accuracy[1] - right[1]).max() < 0.12
    # not the rule of any bad vote: single bad votes are often outvoted
    assert ((p > 0.5) & (patterns == -1).any(axis=1)).sum() > 3


def test_scorer_learns_soft_labels():
    rng = np.random.default_rng(5)
    x = rng.random((400, 6)).astype(np.float32)
    w = weak.train(x, (x[:, 0] > x[:, 1]).astype(float))
    z = x @ w[:-1] + w[-1]
    assert ((z > 0) == (x[:, 0] > x[:, 1])).mean() > 0.95


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\||<|", "", None, "a\nb", "<|nl|>", "日<|"]
    turns = [(c, t, ["user", "assistant", "sys\ntem", None, "<|x"][(c + t) % 5], nasty[(3 * c + t) % 8], "zz") for c in range(8) for t in range(6)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string").drop("formatted")
    out = chat.read_back(chat.formatted(chat.canonical_turns(chat.records_of_turns(frame)))).collect()
    for r in out:
        mine = [((role or ""), (text or "")) for c, _, role, text, _ in turns if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["read_turns"]] == mine
        assert list(r["read_loss"]) == [t for role, t in mine if role == "assistant"]
    assert chat.records_of_turns(frame.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    records = {
        '{"prompt":"p","response":"r"}': [("user", "p"), ("assistant", "r")],
        '{"response":null,"prompt":"p"}': [("user", "p"), ("assistant", "")],
        '{"messages":[{"content":"c","role":"user"},{"role":"assistant","content":"d"}]}': [("user", "c"), ("assistant", "d")],
        '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}': [("user", "h"), ("assistant", "g")],
        '{"instruction":"i","input":"n","output":"o"}': [("user", "i\n\nn"), ("assistant", "o")],
        '{"instruction":"i","output":"o"}': [("user", "i"), ("assistant", "o")],
        # fields that no layout names change nothing, at any depth
        '{"id":7,"prompt":"p","meta":{"a":[1,{"b":2}],"prompt":"x"},"response":"r"}': [("user", "p"), ("assistant", "r")],
        '{"messages":[{"content":"c","role":"user","name":"n","tags":["t"]}],"id":"x"}': [("user", "c")],
        # nested paths are whole paths
        '{"data":{"response":"r","prompt":"p"}}': [("user", "p"), ("assistant", "r")],
        '{"prompt":{"x":"p","response":"r"}}': None,
        '{"other":{"prompt":"p","response":"r"}}': None,
        '{"prompt":["p","q"],"response":"r"}': None,
        '{"messages":{"role":"user","content":"c"}}': None,
        '{"conversation":{"turns":[{"speaker":"bot","text":"t"}]}}': [("assistant", "t")],
        # paths of two layouts: the one with more
        '{"prompt":"p","response":"r","system":"s"}': [("system", "s"), ("user", "p"), ("assistant", "r")],
        '{"prompt":"p","response":"r","question":"q"}': [("user", "p"), ("assistant", "r")],
        # roles of "messages" are as given; an array without turns has none
        '{"messages":[{"role":"human","content":"h"},{"role":"gpt","content":"g"},{"role":"bot","content":"b"}]}': [("human", "h"), ("gpt", "g"), ("bot", "b")],
        '{"messages":[]}': [],
        '{"conversation":{"turns":[]}}': [],
        '{"other":1}': None,
        '[]': None,
        '"text"': None,
    }
    rows = spark.createDataFrame(list(enumerate(records)), "id int, j string").selectExpr("id", "parse_json(j) as record", "'mine' as paths")
    got = chat.canonical_turns(rows).orderBy("id").collect()
    assert [None if r["turns"] is None else [tuple(t) for t in r["turns"]] for r in got] == list(records.values())
    assert {r["paths"] for r in got} == {"mine"}
    both = chat.digests(chat.formatted(chat.canonical_turns(rows.withColumnsRenamed({"id": "conv_id", "paths": "_parts"}).withColumn("parts", chat.F.lit(1)))))
    done = {r["conv_id"]: r for r in both.collect()}
    at = list(records).index('{"messages":[]}')
    assert (done[at]["n_turns"], done[at]["loss_chars"], done[at]["formatted_chars"]) == (0, 0, 0)
    given = chat.formatted(chat.canonical_turns(rows.withColumn("_parts", chat.F.lit("own")).withColumn("parts", chat.F.lit(2))))
    assert {(r["_parts"], r["parts"]) for r in given.collect()} == {("own", 2)}


def test_roles_of_rows_are_as_given(spark):
    rows = [(1, 0, "human", "q"), (1, 1, "gpt", "a"), (1, 2, "assistant", "b")]
    got = chat.digests(chat.formatted(chat.canonical_turns(chat.records_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).first()
    assert got["turns_sha256"] == hashlib.sha256(b"human\nq\ngpt\na\nassistant\nb\n").hexdigest()
    assert got["loss_chars"] == 1 and got["loss_sha256"] == hashlib.sha256(b"b").hexdigest()


def test_field_paths(spark):
    text = '{"a b":{"c":[[{"d":1.5,"e":null}]],"f`g":true},"h":[1,"x"],"i":{},"j":[],"k":"2024-01-01"}'
    got = spark.createDataFrame([(text,)], "j string").selectExpr("parse_json(j) as r").select(chat.field_paths(chat.F.col("r")).alias("p")).first()["p"]
    assert got == ["a b.c[][].d", "a b.c[][].e", "a b.f`g", "h[]", "j[]", "k"]


def test_token_records_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    path, name = scratch_path(spark, "records"), tokenizer_path("word_bpe_49k.json")
    index = tokens.write_records(docs, path, name, shard_bytes=4000)
    tok, start = Tokenizer.from_file(name), 0
    got = sorted(tokens.token_starts(index).collect(), key=lambda r: r["start"])
    for (i, t, _), r in zip(sorted(rows, key=lambda x: (x[0], x[1] or "")), got):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert index.select("shard").distinct().count() > 2
    some = tokens.read_at(spark, path, index.filter("doc_id % 7 = 3")).collect()
    text = {i: t or "" for i, t, _ in rows}
    assert some and all(list(r["ids"]) == tok.encode(text[r["doc_id"]], add_special_tokens=False).ids + [1] for r in some)


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits[:n]), "".join("ab"[1 - b] for b in bits[:n])


def test_words_are_told_apart_by_their_bytes():
    from snapfold.llm.common import Words

    a, b = thue_morse(1024)
    texts = [f"{a} {b} {a} x", "", "é 0123456789abcdef 0123456789abcdeX 0123456789abcdefg", " "]
    w = Words([t.encode() for t in texts])
    words = [x for t in texts for x in t.split()]
    assert [w.word(i).decode() for i in range(len(w.start))] == words and w.counts.tolist() == [4, 0, 4, 0] and w.text.tolist() == [0] * 4 + [2] * 4
    w.hash[:] = 7  # even where all hashes are equal
    first, place = w.distinct()
    assert [words[first[k]] for k in place] == words
    table = tokens.WordTable(tokenizer_path("word_bpe_49k.json"))
    for n in (512, 1024, 4096):
        text = " ".join([*thue_morse(n), thue_morse(n)[0]])
        assert list(next(table.encode([text.encode()]))) == table.tok.encode(text, add_special_tokens=False).ids


def test_shards_are_cut_by_size_also_inside_an_id(spark):
    long, one = sentence(3000), sentence(30)
    rows = [(None, one, "s") for _ in range(300)] + [(5, sentence(300), "s") for _ in range(200)] + [(10 + i, long if i < 10 else one, "s") for i in range(400)]
    index = tokens.write_records(frame(spark, rows), scratch_path(spark, "records"), tokenizer_path("word_bpe_49k.json"), shard_bytes=20_000).collect()
    sizes = Counter()
    for r in index:
        sizes[r["shard"]] += r["bytes"]
    assert len(index) == len(rows) and len(sizes) > 20 and max(sizes.values()) < 60_000
    ordered = [r["doc_id"] for r in sorted(index, key=lambda r: (r["shard"], r["position"]))]
    assert ordered == sorted(ordered, key=lambda i: -1 if i is None else i)
    assert len({r["shard"] for r in index if r["doc_id"] is None}) > 2


def test_workers_encode_small_runs_of_texts(monkeypatch):
    """What a worker holds beside its table of words stays within one megabyte of text, and pandas isn't loaded for it."""
    seen, words = [], tokens.Words
    monkeypatch.setattr(tokens, "Words", lambda texts: seen.append(sum(map(len, texts))) or words(texts))
    assert len(list(tokens.WordTable(tokenizer_path("word_bpe_49k.json")).encode([b"ab " * 1000] * 1500))) == 1500
    assert sum(seen) == 4_500_000 and max(seen) <= 1 << 20 and not hasattr(tokens, "pd")


def test_damage_is_found():
    data = tokens.frame(tokens.pack(None, np.array([1, 70000], "<u4"))) + tokens.frame(b"xy")
    assert [tokens.unpack(p)[0] for _, p in itertools.islice(tokens.frames(data), 1)] == [None]
    for at in (0, 9, 14, 30):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises((ValueError, MemoryError)):
            list(tokens.frames(broken))


@pytest.mark.parametrize("seed", [1, 2])
def test_words_encode_as_the_tokenizer(seed):
    rnd = random.Random(seed)
    table = tokens.WordTable(tokenizer_path("word_bpe_49k.json"), words=50, runs=50)
    letters = [*"aZ09 .,'!é", "É", "ß", "×", "J", "ǰ", "̌", "é", "≠", "<|endoftext|>", "'s", "\x1c", "\x85", "\xa0", "\n", "İ", "Σ", "日", "🙂", "K"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    for t, ids in zip(texts, table.encode([t.encode() for t in texts])):
        assert list(ids) == table.tok.encode(t, add_special_tokens=False).ids, t


def test_near_duplicates_against_all_pairs(docs, rows):
    got = simhash.near_duplicates(docs, leaf_rows=8).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    fps = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got}
    assert fps[100] == fps[101] == fps[102] == 0
    least = {i: i for i in fps}
    for _ in fps:
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                least[a] = least[b] = min(least[a], least[b])
    assert all(r["component_id"] == least[r["doc_id"]] for r in got)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = base[rng.integers(0, 60, 1500)]
    for _ in range(4):
        near = near ^ np.where(rng.random(1500) < 0.6, np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64), np.uint64(0))
    points = np.unique(np.concatenate([base, near]))
    tree = simhash.build(points[::3], 40, 3)
    homes = {}
    for leaf, part in simhash.route(tree, points, 3):
        for p in part:
            homes.setdefault(int(p), set()).add(leaf)
    for a in points:
        for b in points[simhash.bits_apart(points, a) <= 3]:
            assert homes[int(a)] & homes[int(b)]
    found = {}
    for members, low in simhash.local_groups(points, 3, small=50):
        for m in members:
            found.setdefault(int(m), set()).add(int(low))
    linked = [a for a in points if (simhash.bits_apart(points, a) <= 3).sum() > 1]
    assert set(map(int, linked)) == set(found)


def test_one_of_each_group_stays(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 106 not in ids and 0 in ids and 8 in ids


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(size=6) * 3).round(1).tolist(), "t") for i in range(300)]
    data += [(1000 + i, [0.5] * 6, "t") for i in range(60)]
    data += [(2000, None, "t"), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0], "t"), (2002, [float("nan")] * 6, "t"), (2003, [float("inf")] * 6, "t"), (2004, [], "t"), (None, [1.0] * 6, "t"), (2020, [1.0, 2.0], "t")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), k=7, block_rows=32, query_rows=4, group_bytes=400).collect()
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in data if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in good:
        if q % 20 == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:7]
            want.update({(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)})
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    for bits in (1, 3, 8):
        again = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), k=7, bits=bits).collect()
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in again} == want and len(again) == len(want)


def test_two_vectors_of_one_id_are_two_queries(spark):
    data = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0])] + [(i, [float(i), 9.0 - i]) for i in range(1, 9)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    lists = {}
    for r in sorted(topk.top_k(frame, frame.filter("vec_id = 0"), k=3).collect(), key=lambda r: r["rank"]):
        lists.setdefault(r["query"], []).append((r["vec_id"], r["score"]))
    assert sorted(lists.values()) == [[(i, 4096 * x) for i, x in ids] for ids in ([(1, 8), (2, 7), (3, 6)], [(8, 8), (7, 7), (6, 6)])]


def test_picked_rows_meet_every_row_but_themselves(spark):
    """As the contract of op6 says, on rows without id, and rows that repeat an id, a vector or both."""
    rng = np.random.default_rng(8)
    data = [(i % 70 if i % 5 else None, (rng.normal(size=4) * 3).round(1).tolist()) for i in range(200)] + [(20, [9.0] * 4), (20, [9.0] * 4), (40, [9.0] * 4), (None, [9.0] * 4), (3, [9.0] * 4), (40, None), (60, [None] * 4)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data if v and None not in v]
    want = []
    for n, (q, x) in enumerate(good):
        if q is not None and q % 20 == 0:
            best = sorted((-int(x @ v), i is None, i or 0) for m, (i, v) in enumerate(good) if m != n)[:20]
            want.append((q, [(None if no else i, -s) for s, no, i in best]))
    for options in ({}, {"bits": 2, "block_rows": 16, "query_rows": 3, "group_bytes": 400}):
        lists = {}
        for r in sorted(topk.top_k(frame, F.expr("vec_id % 20 = 0"), **options).collect(), key=lambda r: r["rank"]):
            lists.setdefault((r["query_id"], r["query"]), []).append((r["vec_id"], r["score"]))
        assert sorted(((q, x) for (q, _), x in lists.items()), key=str) == sorted(want, key=str)


def test_op6_as_its_contract(spark, tmp_path):
    spark.createDataFrame([(20, [1.0, 0.0]), (20, [2.0, 0.0]), (None, [3.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], str(r["vec_id"]), r["score"]) for r in op6_top_k(spark, str(tmp_path)).collect())
    assert got == sorted((20, n, i, 4096 * s) for x in ([("None", 3), ("20", 2), ("1", 1)], [("None", 6), ("1", 2), ("20", 2)]) for n, (i, s) in enumerate(x, 1))


def test_licences(spark):
    texts = {1: "Released under the MIT License.", 2: "mit licensed mit-license", 3: None, 4: "", 5: sentence(50), 6: "x Licensed under CC BY-NC 4.0. y", 7: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge", 8: "GNU General Public License; general public license"}
    got = {r["doc_id"]: r for r in licences.scan_licences(frame(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["score"]) == (1, 3, "mit", 1.0)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["labels"]) == (1, 2, "mit")
    assert (got[3]["n_words"], got[3]["labels"], got[3]["first_word"], got[3]["score"]) == (0, "", None, 0.0) and got[4]["n_words"] == 0
    assert got[6]["labels"] == "cc-by-nc" and got[6]["base_labels"] == ""
    assert got[7]["labels"] == "mit" and 0.6 <= got[7]["score"] < 1
    assert (got[8]["n_base"], got[8]["first_word"], got[8]["last_word"]) == (2, 1, 4)


def test_licence_places_and_spans_against_plain_search(spark):
    rnd = random.Random(8)
    vocab = ["mit", "license", "apache", "general", "public", "gnu", "the", "under", "released", "licensed", "version", "x", "\u00e9t\u00e9"]
    glue = [" ", "  ", "\n", "-", ". ", "_", "/"]
    texts = ["".join(rnd.choice([w, w.upper(), w.capitalize()]) + rnd.choice(glue) for w in rnd.choices(vocab, k=rnd.randint(0, 60))) for _ in range(300)]
    got = {r["doc_id"]: r for r in licences.scan_licences(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        hits = [(k, label) for phrase, label in licences.PHRASES for p in [phrase.encode().split()] for k in range(len(words)) if words[k : k + len(p)] == p]
        places = [k for k, _ in hits]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        for s in r["spans"]:
            # a span holds its share of some template, in order
            inside = [w.decode() for w in words[s["start"] : s["end"]]]
            assert any(label == s["label"] and in_order(text.split(), inside) >= round(s["cover"] * len(text.split())) >= 0.6 * len(text.split()) - 1 for label, text in licences.TEMPLATES)


def in_order(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + list(itertools.accumulate(range(len(b)), lambda best, j, before=row: max(before[j + 1], best, before[j] + (x == b[j])), initial=0))[1:]
    return row[-1]


def test_automaton_matching_statistics():
    rnd = random.Random(2)
    seqs = [[rnd.randint(0, 3) for _ in range(30)] for _ in range(4)]
    auto, text = licences.Automaton(seqs), [rnd.randint(0, 4) for _ in range(300)]
    runs = {tuple(s[i:j]) for s in seqs for i in range(30) for j in range(i + 1, 31)}
    for i, (length, state) in enumerate(auto.matches(text)):
        want = max((n for n in range(31) if n <= i + 1 and (n == 0 or tuple(text[i + 1 - n : i + 1]) in runs)))
        assert length == want
        if length:
            run = text[i + 1 - length : i + 1]
            assert auto.places[state] == sorted((k, e) for k, s in enumerate(seqs) for e in range(30) if s[max(0, e - length + 1) : e + 1] == run)


def test_pieces_as_the_library():
    table = pieces.ChunkTable(tokenizer_path("piece_bpe_32k.model"), limit=40)
    rnd = random.Random(4)
    parts = [" ", "  ", "a", "the", "\n", "\t", pieces.MARK, "é", "日", "<0x0A>", "<s>", "́", "🙂", "\x00", " foo", "　", "�", "▁▁x"]
    texts = ["", " ", "   ", pieces.MARK] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    for t, got in zip(texts, table.digests(texts)):
        ids = [*table.sp.encode(t), table.end]
        assert got == (len(ids), " ".join(map(str, ids)), table.sp.decode(ids)), t


def test_piece_rows(docs, rows):
    model = tokenizer_path("piece_bpe_32k.model")
    assert Counter(r["doc_id"] for r in pieces.piece_digests(docs, model).collect()) == Counter(i for i, _, _ in rows)
    assert {r["doc_id"]: r["ids"] for r in pieces.piece_ids(docs, model).collect()}[100] == [2]


def plain_backoff(rows):
    words = [(i, (t or "").encode().split()) for i, t, _ in rows]
    grams = [[Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in (1, 2, 3)] for _, w in words]
    total, size = [sum((g[n] for g in grams), Counter()) for n in range(3)], sum(len(w) for _, w in words)
    want = Counter()
    for (i, w), own in zip(words, grams):
        def others(g):
            return total[len(g) - 1][g] - own[len(g) - 1][g]
        s = 0
        for k in range(len(w)):
            n, a = min(3, k + 1), 1.0
            while n > 1 and not others(tuple(w[k - n + 1 : k + 1])):
                n, a = n - 1, a * 0.4
            g = tuple(w[k - n + 1 : k + 1])
            s += round(math.log(a * (others(g) / others(g[:-1]) if n > 1 else max(others(g), 0.5) / max(1, size - len(w)))) * 1e6)
        want[i] += s
    return want


def test_backoff_against_plain_counts(spark, docs, rows):
    a, b = thue_morse(1024)
    odd = [(200, f"{a} {b} x", "s"), (201, f"{a} y x", "s"), (202, f"{b} {b} y", "s"), (203, " ".join(rows[3][1].split()[:9]), "s")]
    for data, options in ((rows, {}), (rows + odd, {"block_bytes": 2000, "part_bytes": 3000}), (rows[:3], {"block_bytes": 1}), (rows, {"block_bytes": 500, "most_buckets": 3})):
        want, got = plain_backoff(data), Counter()
        for r in backoff.backoff_scores(frame(spark, data), **options).collect():
            got[r["doc_id"]] += round(r["log_score"] * 1e6)
        assert all(abs(got[i] - want[i]) <= 1 for i in want), options
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("snapfold_blocks")]


def test_pairs_stay_apart():
    rng = np.random.default_rng(6)
    for top in (100, 1 << 40):
        a, b = rng.integers(0, top, 500), rng.integers(0, top, 500)
        a, b = np.concatenate([a, a]), np.concatenate([b, b[::-1]])
        key = backoff.pairs(a, b)
        assert len(np.unique(key)) == len(set(zip(a.tolist(), b.tolist())))
        assert (backoff.unpacked(backoff.packed(a)) == a).all() and (np.cumsum(backoff.unpacked(backoff.rising(np.sort(a)))) == np.sort(a)).all()
    assert len(backoff.unpacked(backoff.packed(np.zeros(0, np.int64)))) == 0


def test_weak_labels_find_planted_junk(spark):
    def prose(n):
        return " ".join("".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 9))) + RND.choice(["", "", "", ".", ","]) for _ in range(n))

    data = [(i, prose(120), "s") for i in range(200)] + [(1000 + i, " ".join(w.upper() + "%%%" for w in prose(80).split()), "s") for i in range(30)] + [(2000 + i, " ".join(["spam"] * 150), "s") for i in range(30)]
    data += [(3000, None, "s"), (3001, "", "s"), (None, prose(100), "s"), (5, data[5][1], "s")]
    frame_, labels = frame(spark, data), spark.createDataFrame([(i, int(i is not None and i < 1000), 0) for i, _, _ in data[::3]], "doc_id long, quality int, toxic int")
    accuracy = {r["labeller"]: r for r in weak.labellers(frame_).collect()}
    assert set(accuracy) == set(weak.LABELLERS) and accuracy["symbols"]["good_accuracy"] > 0.95
    shares = Counter({(r["quality"], r["kept"]): r["rows"] for r in rules.held_out(weak.classify(frame_, labels), labels).collect()})
    assert shares[1, True] > 20 and shares[0, False] > 5 and shares[1, False] + shares[0, True] == 0
    for known in (labels, labels.filter("false")):
        got = weak.classify(frame_, known).collect()
        assert len(got) == len(data)
        assert all(r["kept"] == (r["doc_id"] < 1000) for r in got if r["doc_id"] is not None and r["doc_id"] < 3000)
    assert weak.keep_good(frame_, labels).columns == frame_.columns


def test_scorer_and_threshold_are_of_all_rows(spark):
    """The sums over the table give what training on all its rows at hand gives; every label of fold 0 sets the threshold."""
    data = [(i, sentence(RND.randint(20, 60)) if i % 4 else " ".join(["spam"] * 60), "s") for i in range(9000)]
    docs = frame(spark, data).repartition(3)
    model = weak.learn(docs, dims=64)
    assert model.counts.sum() == len(data)
    got = weak.fit(model)
    order = docs.select("doc_id", "text").collect()
    x = np.zeros((len(order), 64))
    for k, r in enumerate(order):
        size, at, n = next(weak.hashed_features([r["text"].encode()], 64))
        x[k, at] = np.sqrt(n / len(r["text"].split()))
    posterior = {r["doc_id"]: r["posterior"] for r in weak.scored_rows(model, got).collect()}
    want = weak.train(x, np.array([posterior[r["doc_id"]] for r in order]))
    assert np.allclose(got, want, atol=1e-4) and np.abs(want).max() > 1
    scored, linear, _ = weak.judged(docs, spark.range(60_000).selectExpr("id as doc_id", "1 as quality"), 20.0, dims=64)
    assert np.array_equal(linear, got) and scored.count() == len(data)
    assert np.allclose([r["score"] for r in scored.orderBy("doc_id").collect()], weak.hashed([t.encode() for _, t, _ in data], linear))
    many = spark.range(120_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert rules.known_labels(many).count() > 55_000


def test_minimise_finds_the_least():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 8))
    b = rng.normal(size=40)
    w = weak.minimise(lambda w: np.append(a.T @ (a @ w - b), ((a @ w - b) ** 2).sum() / 2), 8, decay=0.3, close=1e-12)
    assert np.allclose(w, np.linalg.solve(a.T @ a + np.diag([0.3] * 7 + [0.0]), a.T @ b), atol=1e-4)


def test_empty_tables(spark, none, labels):
    model, tok = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
    path = scratch_path(spark, "records")
    tables = [mixing.mix(none), mixing.mixed_rows(none), rules.quality_rules(none, labels), tokens.token_starts(tokens.write_records(none, path, tok)), simhash.near_duplicates(none), simhash.keep_one(none), licences.scan_licences(none), pieces.piece_digests(none, model), backoff.backoff_scores(none), weak.classify(none, labels)]
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert [t.count() for t in [*tables, topk.top_k(vectors, vectors)]] == [0] * 11

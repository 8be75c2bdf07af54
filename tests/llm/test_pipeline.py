"""The pipeline's stages, each against a plain version on that stage's own input."""

import itertools
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from snapfold.llm import common, pieces, similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RND = random.Random(3)


@pytest.fixture(autouse=True)
def own_draws():
    RND.seed(3)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def one_of_each(rows, alike=lambda a, b: 5 * len(a & b) >= 4 * len(a | b)):
    """Ids that a plain search over all pairs keeps: the smallest of each component."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if label[a] != label[b] and alike(sets[a], sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    return sorted(min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in set(label))


def copies():
    """Texts, and copies of them at similarities on both sides of 0.8 up to 0.99."""
    words = lambda n: [f"W{RND.randint(0, 5000)}" for _ in range(n)]
    common, rows = words(60), []
    for k in range(40):
        base = words(RND.choice([12, 60, 250, 1200])) + (common if k % 4 == 0 else [])
        rows.append((100 * k, " ".join(base)))
        for c in range(1, 7):
            changed = list(base)
            for at in RND.sample(range(len(base)), RND.choice([1, 2, max(1, len(base) // 35)])):
                changed[at] = f"x{RND.random()}"
            rows.append((100 * k + c, " ".join(changed).lower()))
    rows += [(9000 + k, " ".join(common + words(k % 9))) for k in range(30)]
    return rows + [(9100, None), (9101, " "), (9102, "one two"), (9103, "One  two"), (9104, "one")]


def test_near_copies_from_08_are_linked(spark):
    rows = copies()
    sets = {i: shingles(t) for i, t in rows}
    near = [len(sets[i] & sets[i - i % 100]) / len(sets[i] | sets[i - i % 100]) for i in sets if i < 9000 and i % 100]
    assert sum(0.8 <= s < 0.85 for s in near) > 5 and sum(0.97 <= s < 1 for s in near) > 5 and sum(s < 0.8 for s in near) > 5
    docs = frame(spark, rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == one_of_each(rows)
    assert sorted(r["doc_id"] for r in similar.keep_one(docs, sample_rows=5).collect()) == one_of_each(rows)
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_first_links_are_of_the_fingerprint_tree(spark):
    """The stage's points go through SimHash and the tree of op5 whole; only pairs of similar sets become links."""
    rows = copies() + [(9200, "a b c d e f"), (9201, "A b  c d e f")]
    own = similar.numbered_points(similar.keyed(frame(spark, rows)), 5)
    points = {r["node"]: r for r in own.collect()}
    for r in points.values():
        assert r["fp"] == simhash.fingerprint(bytes(r["text"] or b""), 5, 42)
    pairs = [(r["a"], r["b"]) for r in similar.tree_pairs(own, 3, leaf_rows=16, tree_rows=50).collect()]
    for linked in (pairs, [(a, b) for a, b in itertools.combinations(points, 2) if ((points[a]["fp"] ^ points[b]["fp"]) & (1 << 64) - 1).bit_count() <= 3]):
        label = {n: n for n in points}
        for a, b in linked:
            if label[a] != label[b]:
                x, y = label[a], label[b]
                label = {n: x if v == y else v for n, v in label.items()}
        groups = {frozenset(n for n in points if label[n] == v) for v in set(label.values())}
        assert linked is pairs or groups == before
        before = groups
    assert any(len(g) > 1 for g in groups)
    links = {(r["a"], r["b"]) for r in similar.similar_pairs(similar.tree_pairs(own, 3), own, 5, 80).collect()}
    sets = {n: shingles(bytes(r["text"] or b"").decode()) for n, r in points.items()}
    assert links and links <= set(map(tuple, itertools.combinations(sorted(points), 2)))
    assert all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in links)


def test_bitmaps_differ_in_no_more_bits_than_sets_do():
    rng, tight = np.random.default_rng(4), 0
    for _ in range(300):
        n, extra = rng.integers(1, 3000), rng.integers(0, 400, 2)
        h = np.unique(rng.integers(0, 1 << 63, n + extra.sum(), dtype=np.uint64))
        a, b = h[: n + extra[0]], np.concatenate([h[:n], h[n + extra[0] :]])
        size = lambda s: max(1024, 1 << (4 * len(s) - 1).bit_length())
        apart = len(np.setxor1d(a, b))
        for p, q in ((size(a), size(b)), (256, 256)):
            bits = similar.differing(similar.bitmap(a, p).tobytes(), similar.bitmap(b, q).tobytes())
            assert bits <= apart and (apart - bits) % 2 == 0
            tight += p > 256 and bits > 0.8 * apart
    assert tight > 200


def test_many_near_copies_of_one_text(spark):
    """Copies of one text at similarities on both sides of 0.8, all of them sharing shingles."""
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in RND.sample(range(len(words)), RND.choice([1, 3, 4, 5, 8, 20])):
            words[at] = f"x{RND.random()}"
        rows.append((i, " ".join(words)))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect())
    assert kept == one_of_each(rows) and 10 < len(kept) < 150


def prose(n):
    return " ".join("".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 9))) + RND.choice(["", "", "", ".", ","]) for _ in range(n))


def write_tables(spark, path, rows, labels):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def odd(n):
    return " ".join(w.upper() + "%%%" for w in prose(n).split())


def test_forest_rejects_where_no_labelled_bad_row_is_left(spark, tmp_path):
    rows = [(i, prose(120)) for i in range(200)] + [(1000 + i, odd(80)) for i in range(40)]
    # bad ones with odd ids have labels, and are gone when the stage runs
    write_tables(spark, tmp_path, rows, [(i, int(i < 1000), 0) for i, _ in rows if i < 100 or i > 1000 and i % 2])
    left = frame(spark, [r for r in rows if r[0] < 1000 or r[0] % 2 == 0])
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, left, str(tmp_path)).collect()}
    assert max(kept) < 1000 and len(kept) > 190


def test_rows_without_id_or_with_one_id_are_judged_alone(spark, tmp_path):
    rows = [(i, prose(120)) for i in range(200)] + [(1000 + i, odd(80)) for i in range(40)]
    write_tables(spark, tmp_path, rows, [(i, int(i < 1000), 0) for i, _ in rows[::2]])
    clean = [(None, prose(120)), (None, prose(120)), (7000, prose(120)), (7000, prose(120))]
    junk = [(None, None), (None, odd(80)), (7000, odd(80)), (7000, ""), (7001, odd(80))]
    docs = frame(spark, rows[:100] + clean + junk + clean[:1] + clean[2:3])
    twice = sorted(t for _, t in [*clean, clean[0], clean[2]])
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.quality_rules):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert sorted(r["text"] for r in got.filter("doc_id is null or doc_id >= 1000").collect()) == twice
    # distinct texts all stay, the same row twice stays once
    got = corpus_pipeline.near_duplicates(spark, frame(spark, clean + clean), str(tmp_path)).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t in clean)


def test_all_stages_in_a_row(spark, tmp_path):
    import sentencepiece

    texts = [prose(RND.randint(40, 160)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, odd(80)) for i in range(30)] + [(2000 + i, t + " more") for i, t in enumerate(texts[:20])]
    rows += [(None, prose(90)), (None, prose(90)), (None, None), (3000, ""), (5, texts[5]), (5, prose(60)), (3001, " ".join(texts))]
    docs = spark.createDataFrame([(i, t, None if k % 9 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None) for k, (i, t) in enumerate(rows)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows[:180:2]] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = lambda df: sorted(map(repr, df.collect()))
    at = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(df.columns == docs.columns for df in at[:-1])
    given, good, ruled, alone, mixed, ids = ([r for r in df.collect()] for df in at)
    # the filters keep rows as they are, and all clean ones
    clean = {t for i, t in rows if t and (i is None or not 1000 <= i < 2000)}
    assert {r["text"] for r in good} == {r["text"] for r in ruled} == clean
    assert len(ruled) == sum(bool(r["text"]) and not (r["doc_id"] is not None and 1000 <= r["doc_id"] < 2000) for r in given)
    # near-duplicates against all pairs, with nulls last
    numbered = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in ruled))
    kept = one_of_each([(k, t) for k, (_, _, t) in enumerate(numbered)])
    assert sorted(r["text"] for r in alone) == sorted(numbered[k][2] for k in kept)
    # the mix repeats whole rows, to the targets that its own sizes give
    size = lambda rows_: {s: sum(len(r["text"].split()) for r in rows_ if r["source"] == s) for s in {r["source"] for r in alone}}
    assert {repr(r) for r in mixed} <= {repr(r) for r in alone}
    names = sorted(size(alone), key=lambda s: (s is None, s or ""))
    targets = corpus_pipeline.mixing.targets_by_weight([size(alone)[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0)
    big = max(len(r["text"].split()) for r in alone)
    assert all(abs(size(mixed)[s] - t) <= (big if any(r["doc_id"] == 3001 and r["source"] == s for r in alone) else 60) for s, t in zip(names, targets))
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.tokenizer_path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, [*library.encode(r["text"]), library.eos_id()]) for r in mixed)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"])) for r in ids) == want
    assert plain(corpus_pipeline.run(spark, str(tmp_path))) == plain(at[-1])


def test_workers_hold_short_runs_and_bounded_tables():
    """A worker's memory: no pandas, no second copy of a whole batch, and a table of chunks of bounded size."""
    loads = "import sys, snapfold.llm.similar, snapfold.llm.weak, snapfold.llm.mixing, snapfold.llm.pieces; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", loads], check=False).returncode == 0
    texts = [None, "", "x" * 3_000_000, *(prose(2000) for _ in range(60)), *["a b"] * 3000]
    column = pa.array([t and t.encode() for t in texts], pa.binary())[1:]
    runs = list(common.parts(column, column))
    assert [t for r in runs for t in r.to_pylist()] == column.to_pylist() == list(common.each_text(column))
    assert all(len(r) <= 1024 and (len(r) == 1 or sum(map(len, r.to_pylist())) <= 1 << 20) for r in runs)
    assert len(list(common.parts(column[:0], column[:0]))) == 0
    many = pa.array([b" ".join(b"%d" % (k * i) for k in range(100)) for i in range(60_000)])
    tracemalloc.start()
    assert len(next(similar.sets_of(many, 5))) == 1
    assert tracemalloc.get_traced_memory()[1] < many.nbytes / 2
    tracemalloc.stop()
    table = pieces.ChunkTable(corpus_pipeline.tokenizer_path("piece_bpe_32k.model"))
    lots = [" ".join(f"w{k * 1000 + i}" for i in range(1000)) for k in range(150)]
    for text, (n, ids, said) in zip(lots, (d for lo in range(0, 150, 10) for d in table.digests(lots[lo : lo + 10]))):
        want = [*table.sp.encode(text), table.end]
        assert (n, ids, said) == (len(want), " ".join(map(str, want)), table.sp.decode(want))
    assert len(table.table) <= 100_000

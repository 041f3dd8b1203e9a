"""N-gram join, embedding near-duplicates, audio fingerprints, components."""

import random
from pathlib import Path

import numpy as np
import pytest

from tests.llm import brute
from twinvec.llm import chroma, common, embed_dedup, ngram_join, queries


def check_grams(spark, docs, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n string").repartition(3)
    got = ngram_join.ngram_join(df, **options).collect()
    assert len(got) == len(docs)
    want = brute.ngram_join(docs, options.get("n", 4), options.get("percent", 85))
    assert [(r.doc_id, r.n_shingles, r.component_id, want[r.doc_id]) for r in got if (r.n_shingles, r.component_id) != want[r.doc_id]] == []


def test_ngram_query(spark, sf):
    d = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    want = brute.ngram_join([tuple(r) for r in d])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_ngram_join(spark, sf).collect()} == want


def family(rng, docs):
    vocabulary = [f"w{i}" for i in range(50)]
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 45))]
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((len(docs) * 3 + 1, " ".join(w[: rng.randint(1, len(w))] if rng.random() < 0.3 else w)))
    return docs


def test_ngram_groups_with_tiny_limits(spark, monkeypatch):
    """Large groups, frequent grams and blocks at a size where all of them occur."""
    for name, v in (("SMALL", 3), ("BLOCK", 4), ("HEAVY_DF", 3), ("CHUNK", 400)):
        monkeypatch.setattr(ngram_join, name, v)
    docs = family(random.Random(5), [])
    check_grams(spark, [*docs, (9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (9005, "x " * 30_000)])


def test_ngram_other_sizes(spark):
    check_grams(spark, family(random.Random(6), []), n=5, percent=80)


def test_ngram_empty_and_repeated(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A b C d e"), (3, None)]
    got = sorted(tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def by_row(spark, rows, n=4, percent=85):
    """Rows under repeated and null ids against brute force over row numbers."""
    want = brute.ngram_join([(i, t) for i, (_, t) in enumerate(rows)], n, percent)
    least = {}
    for i, (k, _) in enumerate(rows):
        c = want[i][1]
        least[c] = k if least.get(c) is None else least[c] if k is None else min(k, least[c])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_join.ngram_join(df, n, percent).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted([(k, want[i][0], least[want[i][1]]) for i, (k, _) in enumerate(rows)], key=key)
    kept = ngram_join.near_duplicates(df.withColumn("row", df["doc_id"]).withColumn("uid", df["text"]).withColumn("digest", df["doc_id"]), n, percent)
    assert kept.columns == ["doc_id", "text", "row", "uid", "digest"]
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault(want[i][1], []).append((k is None, k or 0, t))
    assert len(kept) == len(groups)
    for g in groups.values():
        none, k, _ = min(g, key=lambda x: x[:2])
        assert any((None if none else k, t) in kept for a, b, t in g if (a, b) == (none, k))


def test_ngram_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(24)]
    a, b = " ".join(words), " ".join(words[::-1])
    by_row(spark, [(1, a), (1, b), (2, b + " x"), (3, a + " y"), (None, a + " z"), (None, "p q r s t u v"), (None, "p q r s t u v"), (4, None), (4, ""), (5, "c d e f")])
    rng = random.Random(11)
    by_row(spark, [(None if rng.random() < 0.1 else rng.randrange(40), t) for _, t in family(rng, [])])


def test_ngram_hot_grams_meet_in_the_sender(spark, monkeypatch):
    for name, v in (("SMALL", 2), ("FLUSH", 300), ("BLOCK", 4), ("CHECKED", 2), ("RANGE_ROWS", 1)):
        monkeypatch.setattr(ngram_join, name, v)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join(common + [f"u{i}x{j}" for j in range(rng.randint(0, 8))])) for i in range(120)]
    check_grams(spark, docs + [(500 + i, f"{t} tail") for i, t in docs[:40]])


@pytest.mark.parametrize("held", [1_000_000, 40])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(common, "HELD", held)
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    u = brute.Union({x for e in links for x in e})
    for a, b in links:
        u.join(a, b)
    got = {r.id: r.component_id for r in common.components(spark.createDataFrame(links, "a long, b long"), 600).collect()}
    assert got == {i: u.find(i) for e in links if e[0] != e[1] for i in e}


VECTORS = "vec_id long, embedding array<float>, label int, n_links string"


def check_vectors(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(df, **options).select("vec_id", "n_links", "component_id", "kept").collect())
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    assert got == brute.embeddings(single)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(1)
    rows = []
    for _ in range(6):
        base = r.normal(size=8)
        rows += [((len(rows) + k) * 7 % 5003, (base + r.normal(size=8) * r.choice([0.01, 0.1, 0.3])).tolist(), int(r.integers(0, 2))) for k in range(50)]
    return rows + [
        (9001, None, 1), (9002, [0.0] * 8, 1), (9003, [float("nan")] + [1.0] * 7, 1), (9004, [1.0] * 8, None), (9005, [None] + [1.0] * 7, 0),
        (9006, [1.0] * 4, 0), (9007, [1.0] * 4, 0), (9007, [1.0] * 4, 0), (9008, [1e30] * 8, 0), (9009, [float("inf")] * 8, 0), (9010, [], 0),
    ]


def test_vectors_in_cells(spark, vectors, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LEAF", 6)
    check_vectors(spark, vectors, cell=40)


def test_vectors_in_one_cell(spark, vectors):
    check_vectors(spark, vectors)


def test_vectors_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_query(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in queries.table(spark, sf, "embeddings").collect()]
    assert sorted(tuple(r) for r in queries.op3_embedding_dedup(spark, sf).collect()) == brute.embeddings(rows)


def test_cover_tree_covers():
    x = np.random.default_rng(3).normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = embed_dedup.CoverTree(x, leaf=5)
    for node, kids in enumerate(t.children):
        p = t.points(node)
        assert np.sqrt(((x[p] - x[t.centre[node]]) ** 2).sum(1)).max() <= t.radius[node] + 1e-6
        if kids:
            assert sorted(np.concatenate([t.points(k) for k in kids]).tolist()) == sorted(p.tolist())
            assert t.centre[node] in [t.centre[k] for k in kids]
            assert all(t.radius[k] <= t.radius[0] for k in kids)


def test_recordings(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(25):
        v = r.normal(size=64)
        rows += [(4 * k, v.tolist()), (4 * k + 1, v.tolist()), (4 * k + 2, (v + r.normal(size=64) * 0.02).tolist()), (4 * k + 3, r.normal(size=64).tolist())]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [1.0] * 64), (1004, [1.0] * 64), (1005, [1.0] * 3)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "rec_id long, embedding array<double>, n int")
    got = {x.rec_id: x.component_id for x in chroma.match(df, "embedding", chroma.NOTE_RATE, chroma.melody).collect()}
    fps = [chroma.fingerprint(chroma.melody(v if v is not None else []), chroma.NOTE_RATE) for _, v in rows]
    u = brute.Union([i for i, _ in rows])
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if chroma.same_recording(a, b) or (len(a) >= chroma.MIN_OVERLAP and len(a) == len(b) and (a == b).all()):
                u.join(rows[i][0], rows[j][0])
    assert got == {i: u.find(i) for i, _ in rows}
    assert sum(got[4 * k + 1] == 4 * k for k in range(25)) == 25 and sum(got[4 * k + 2] == 4 * k for k in range(25)) >= 20
    assert chroma.match(df.limit(0), "embedding", chroma.NOTE_RATE, chroma.melody).count() == 0


def test_alignment_of_a_later_cut():
    rate, r = 4000, np.random.default_rng(8)
    x = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (r.integers(0, 24) / 12) * np.arange(1000) / rate) for _ in range(60)])
    hop = (1 << 9) // chroma.OVERLAP
    a, b = chroma.fingerprint(x, rate), chroma.fingerprint(x[40 * hop :] + r.normal(size=len(x) - 40 * hop) * 0.005, rate)
    votes, offset, n, ber = chroma.align(a, b)
    assert offset == -40 and votes > 20 and n >= 16 and ber < 0.1
    assert chroma.same_recording(a, b) and not chroma.same_recording(a, chroma.fingerprint(r.normal(size=60_000), rate))
    assert len(chroma.fingerprint(np.zeros(50_000), rate)) > 0


def test_pcm_decoding(spark):
    x = (np.sin(np.arange(40_000) / 7) * 12_000).astype("<i2")
    df = spark.createDataFrame([(1, x.tobytes()), (2, x.tobytes()), (3, None)], "rec_id long, pcm binary")
    assert {(r.rec_id, r.class_id) for r in chroma.match(df, rate=11025).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_tables_hold_data_files_alone(spark):
    """Each further local file costs the JVM a fork, which counts with all of its memory."""
    t = common.written(spark.range(100), "alone", 3)
    files = [p.name for p in Path(t._twinvec_path.removeprefix("file:")).iterdir()]
    assert 0 < len(files) <= 3 and all(f.startswith("part-") and f.endswith(".parquet") for f in files)
    assert sorted(r.id for r in t.collect()) == list(range(100))


def test_result_of_few_rows_has_few_files(spark, many_partitions):
    df = spark.createDataFrame([(i, f"a b c d e {i // 2}") for i in range(100)], "doc_id long, text string").repartition(50)
    out = ngram_join.ngram_join(df)
    assert out.rdd.getNumPartitions() <= 8 and out.count() == 100
    kept = ngram_join.near_duplicates(df)
    assert kept.rdd.getNumPartitions() <= 12 and kept.count() == 50

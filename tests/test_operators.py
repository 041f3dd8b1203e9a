import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinvec.index import TwinIndex
from twinvec.operators import graph, knn, layout, metrics, pq, search, shard, skyline
from twinvec.plans import fixture as X
from twinvec.sources import vecbin
from twinvec.streaming.dynamic import DynamicIndex, failed_deletes


@pytest.fixture(scope="module")
def points(spark, sf):
    return X.points(spark, sf).select("id", "x", "y").where("id < 300").cache()


@pytest.fixture(scope="module")
def queries(spark, sf):
    return X.queries(spark, sf).select("qid", "x", "y", "alpha").where("qid < 300").cache()


@pytest.fixture(scope="module")
def edges(points):
    return graph.build_dual(points, degree=12, pool=30).cache()


@pytest.fixture(scope="module")
def truth(points, queries):
    return knn.exact_dual_knn(points, queries, 10).cache()


def peel(d1, d2, ids):
    """Skyline after skyline, by definition."""
    left, out, k = list(np.lexsort((ids, d1, d2))), {}, 0
    while left:
        best, keep = np.inf, []
        for i in left:
            if d1[i] < best:
                best, out[i] = d1[i], k
            else:
                keep.append(i)
        left, k = keep, k + 1
    return out


def test_layers_equal_peeling(spark):
    rng = np.random.default_rng(1)
    rows = [(q, i, float(rng.integers(0, 12)), float(rng.integers(0, 12))) for q in range(8) for i in range(60)]
    got = {(r.qid, r.id): r.layer for r in skyline.skyline_layers(spark.createDataFrame(rows, "qid long, id long, d1 double, d2 double")).collect()}
    for q in range(8):
        mine = [r for r in rows if r[0] == q]
        want = peel([r[2] for r in mine], [r[3] for r in mine], [r[1] for r in mine])
        assert all(got[q, mine[i][1]] == k for i, k in want.items())


def test_entry_points_equal_one_scan(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 50)), float(rng.integers(0, 50))) for i in range(400)]
    want, best = set(), 0.0
    for i, a, _ in sorted(rows, key=lambda r: (-r[2], -r[1], r[0])):
        if a > best:
            best = a
            want.add(i)
    assert {r.id for r in skyline.entry_points(spark.createDataFrame(rows, "id long, d1 double, d2 double")).collect()} == want


def test_exact_knn_with_ties_and_small_bases(spark):
    base = spark.createDataFrame([(i, [0.0], [1.0]) for i in range(5)], "id long, x array<double>, y array<double>")
    q = spark.createDataFrame([(0, [0.0], [1.0], 0.3)], "qid long, x array<double>, y array<double>, alpha double")
    assert [(r["rank"], r.id) for r in knn.exact_dual_knn(base, q, 3).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert knn.exact_dual_knn(base.limit(0), q, 3).count() == 0
    assert knn.exact_dual_knn(base, q.limit(0), 3).count() == 0


def test_graph_invariants(points, edges):
    e = edges.toPandas()
    assert not (e["src"] == e["dst"]).any() and not e.duplicated(["src", "dst"]).any()
    assert set(e["dst"]) <= {r.id for r in points.select("id").collect()}
    for r in e["ranges"]:
        flat = [v for s in r for v in (s["lo"], s["hi"])]
        assert flat == sorted(flat) and flat[0] >= 0 and flat[-1] <= 1 and sum(s["hi"] - s["lo"] for s in r) >= graph.MIN_WIDTH - 1e-9


def test_pruned_weights_against_a_grid():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(25, 3)), rng.normal(size=(25, 3))
    s = rng.normal(size=3), rng.normal(size=3)
    d1, d2 = np.linalg.norm(x - s[0], axis=1), np.linalg.norm(y - s[1], axis=1)
    chosen = graph.prune_dual(np.arange(25), d1, d2, x, y, degree=100)
    before: list[int] = []
    for c, _, left in chosen:
        for a in np.linspace(0.005, 0.995, 100):
            f = lambda u, v, a=a: a * u + (1 - a) * v
            gone = any(f(d1[p], d2[p]) < f(d1[c], d2[c]) and f(np.linalg.norm(x[p] - x[c]), np.linalg.norm(y[p] - y[c])) < f(d1[c], d2[c]) for p in before)
            near_end = any(min(abs(a - lo), abs(a - hi)) < 1e-6 for lo, hi in left)
            assert near_end or gone != any(lo <= a <= hi for lo, hi in left)
        before.append(c)


@pytest.mark.parametrize("mode", search.MODES)
def test_search_recall(points, edges, queries, truth, mode):
    got = search.search(points, edges, queries, 10, pool=80, mode=mode)
    recall = metrics.recall_at_k(got, truth, 10).agg(F.avg("recall")).first()[0]
    assert recall >= (80 if mode == "rerank" else 90)


def test_full_pool_is_exact(points, edges, queries, truth):
    got = search.search(points, graph.with_ranges(edges, "none"), queries, 10, pool=300)
    assert {(r.qid, r["rank"], r.id) for r in got.collect()} == {(r.qid, r["rank"], r.id) for r in truth.collect()}


def test_joins_find_what_the_walk_finds(points, edges, queries, truth):
    got = search.search_frames(points, edges, queries.where("qid < 100"), 10, pool=80)
    assert metrics.recall_at_k(got, truth.where("qid < 100"), 10).agg(F.avg("recall")).first()[0] >= 90


def test_other_builders(points):
    one = points.select("id", F.col("x").alias("vec"))
    s = graph.build_single(one, 8, 20)
    assert s.groupBy("src").count().agg(F.max("count")).first()[0] <= graph.SLACK * 8 + 1
    assert graph.build_fixed(points, 0.5, 8, 20).groupBy("src").count().agg(F.max("count")).first()[0] <= 8
    m = shard.build_sharded(points, max_rows=120, degree=8, pool=20)
    assert m.select("src").distinct().count() == 300
    assert shard.merge_shards(m, 3).groupBy("src").count().agg(F.max("count")).first()[0] == 3
    assert graph.bfs_cache(m, points.where("id = 0"), 50).count() == 50
    sizes = shard.partition_with_budget(one, 100, 2).groupBy("cid", "part").count()
    assert sizes.agg(F.sum("count")).first()[0] == 600


def test_quantisation(points, queries):
    one = points.select("id", F.col("x").alias("vec"))
    book = pq.train(one, 8, 32, 32)
    fixed = pq.fixed_codebook(one, 8, 32, 32)
    rows = one.toPandas()

    def error(b):
        books, codes = pq._books(b), pq.encode(one, b).toPandas().set_index("id")["codes"]
        return sum(((np.asarray(v) - np.concatenate([bk[c] for bk, c in zip(books, codes[i], strict=True)])) ** 2).sum() for i, v in zip(rows["id"], rows["vec"], strict=True))

    assert error(book) < error(fixed)
    a = pq.train(one, 8, 32, 32).orderBy("chunk", "code").toPandas()
    b = pq.train(one, 8, 32, 32).orderBy("chunk", "code").toPandas()
    assert np.allclose(np.stack(a["centroid"]), np.stack(b["centroid"]))
    assert pq.refine(one, fixed).groupBy("chunk").count().count() == 8


def test_layout(points):
    assert [(b := layout.topology_bytes(40, s), layout.records_per_page(b)) for s in (6, 7, 2, 0)] == [(644, 12), (724, 11), (324, 25), (164, 49)]
    pages = layout.assign_pages(points, 7)
    assert tuple(layout.violations(pages, points, 7).first()) == (0, 0, 0, 0)
    assert tuple(layout.violations(pages.union(pages.limit(1)), points, 7).first())[1] == 1
    assert layout.pad_pages(pages, 7).where(F.size("ids") != 7).count() == 0
    q = layout.random_rotation(32)
    assert np.allclose(q @ q.T, np.eye(32))
    turned = layout.rotate(points.select("id", F.col("x").alias("vec")), q).orderBy("id").limit(2).collect()
    plain = points.select("id", "x").orderBy("id").limit(2).collect()
    assert np.isclose(np.linalg.norm(np.subtract(turned[0].vec, turned[1].vec)), np.linalg.norm(np.subtract(plain[0].x, plain[1].x)))
    assert sorted(layout.dimension_order(9)) == list(range(9))
    assert layout.shuffle_rows(points).select("id").collect() == layout.shuffle_rows(points.repartition(3)).select("id").collect()


def test_greedy_pages_keep_cliques_together(spark):
    e = spark.createDataFrame([(a, b) for base in (0, 10, 20) for a in range(base, base + 4) for b in range(base, base + 4) if a != b], "src long, dst long")
    pages = layout.greedy_pages(e, 4).groupBy("page_id").agg(F.countDistinct(F.floor(F.col("id") / 10)).alias("n"))
    assert pages.agg(F.max("n")).first()[0] == 1


def test_metrics(spark):
    truth = spark.createDataFrame([(0, 1, 5, 1.0), (0, 2, 6, 2.0), (0, 3, 7, 2.0)], "qid long, rank long, id long, dist double")
    got = spark.createDataFrame([(0, 7), (0, 7), (0, 5)], "qid long, id long")
    assert tuple(metrics.recall_at_k(got, truth, 2).first()) == (0, 2, 100.0)  # the tie at the second place counts
    one = spark.createDataFrame([("s", 1, 1.0, 0.92)], "series string, budget int, cost double, recall double")
    assert metrics.matched_recall(one, [0.95]).count() == 0
    falling = spark.createDataFrame([("s", 1, 1.0, 0.97), ("s", 2, 2.0, 0.90)], one.schema)
    assert metrics.matched_recall(falling, [0.95]).count() == 0
    a = spark.createDataFrame([(0.1,), (0.9,), (0.0,), (1.0,)], "a double")
    kx, ky = metrics.budget_split(F.col("a"), 10)
    assert [tuple(r) for r in a.select(kx, ky).collect()] == [(2, 18), (18, 2), (0, 20), (20, 0)]
    v = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert [metrics.percentile_floor(v, "v", p).first().value for p in (0.0, 0.5, 0.99)] == [0.0, 5.0, 9.0]
    with pytest.raises(ValueError):
        search.truth_window(truth, 6, 8, 3, strict=True)


def test_vector_files(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), i / 2, -1.0]) for i in range(20)], "id long, vec array<float>")
    for kind, name in (("bin", "a.bin"), ("fvecs", "a.fvecs")):
        vecbin.write_vectors(df, str(tmp_path / name), kind=kind)
        assert vecbin.read_vectors(spark, str(tmp_path / name), kind=kind).orderBy("id").collect() == df.orderBy("id").collect()
    small = spark.createDataFrame([(0, [1, 255]), (1, [0, 7])], "id long, vec array<smallint>")
    vecbin.write_vectors(small, str(tmp_path / "b.bin"), "uint8")
    assert vecbin.read_vectors(spark, str(tmp_path / "b.bin"), "uint8").orderBy("id").collect() == small.collect()
    assert vecbin.write_vectors(df, str(tmp_path / "c.bin"), align=4096) == 4096
    truth = spark.createDataFrame([(q, r, q * 10 + r, r / 2) for q in range(3) for r in (1, 2)], "qid long, rank long, id long, dist double")
    vecbin.write_truth(truth, str(tmp_path / "t"), 2)
    assert vecbin.read_truth(spark, str(tmp_path / "t")).select("qid", "rank", "id", "dist").orderBy("qid", "rank").collect() == truth.collect()
    (tmp_path / "bad.bin").write_bytes(b"\2\0\0\0\2\0\0\0\0")
    with pytest.raises(Exception, match="bytes"):
        vecbin.read_vectors(spark, str(tmp_path / "bad.bin")).count()


def test_dynamic_index(spark, points, queries, tmp_path):
    start, more = points.where("id < 200"), points.where("id >= 200 and id < 260")
    ix = DynamicIndex(spark, f"file://{tmp_path}/ix", 12, 30)
    ix.build(start.withColumnRenamed("id", "tag"))
    ins = more.select(F.col("id").alias("seq"), F.lit("insert").alias("op"), F.col("id").alias("tag"), "x", "y")
    none = F.lit(None).cast("array<double>")
    dels = start.where("id % 5 = 0 and id >= 20").select((F.col("id") + 1000).alias("seq"), F.lit("delete").alias("op"), F.col("id").alias("tag"), none.alias("x"), none.alias("y"))
    ops = ins.union(dels)
    ops.write.parquet(f"{tmp_path}/ops")
    q = ix.stream(spark.readStream.schema(ops.schema).parquet(f"{tmp_path}/ops"), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    ix.apply_batch(ops, 0)  # sent again: nothing changes
    alive = {r.id for r in start.where("not (id % 5 = 0 and id >= 20)").union(more).select("id").collect()}
    assert {r.tag for r in ix.points().collect()} == alive
    now = points.where(F.col("id").isin(*alive))
    want = knn.exact_dual_knn(now, queries, 10)
    for _ in range(2):
        got = ix.search(queries, 10, pool=120)
        assert {r.id for r in got.collect()} <= alive
        assert metrics.recall_at_k(got, want, 10).agg(F.avg("recall")).first()[0] >= 90
        ix.compact()
    assert ix.version() == 2
    known = spark.createDataFrame([(1,)], "tag long")
    asked = spark.createDataFrame([("delete", 1), ("delete", 9)], "op string, tag long")
    assert [r.tag for r in failed_deletes(asked, known).collect()] == [9]


def test_visit_counts(points, edges, queries):
    t = search.trace(points, edges, queries, 20)
    assert metrics.visit_counts(t).agg(F.sum("visits")).first()[0] == t.count()
    assert metrics.discovery_counts(t).agg(F.sum("freq")).first()[0] == t.where("parent is not null").select("qid", "id").distinct().count()
    assert isinstance(t.limit(1).toPandas(), pd.DataFrame)


def test_equal_distances_go_to_the_smallest_ids(spark):
    rows = [(i, [1.0, 0.0], [0.5, 0.5]) for i in range(500)] + [(i, [1.0, 1e-9 * i], [0.5, 0.5]) for i in range(500, 520)]
    base = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    q = spark.createDataFrame([(-1, [0.0, 0.0], [0.0, 0.0], 0.3), (4, [1.0, 0.0], [0.5, 0.5], 0.5)], "qid long, x array<double>, y array<double>, alpha double")
    for parts in (1, 7):
        for digits in (None, 6):
            got = knn.exact_dual_knn(base.repartition(parts), q, 10, digits=digits).orderBy("qid", "rank").collect()
            assert [r.id for r in got] == [*range(10), *[i for i in range(11) if i != 4]]


def test_exact_knn_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 3)), 1)  # many ties
    base = spark.createDataFrame([(i, v.tolist(), (-v).tolist()) for i, v in enumerate(x)], "id long, x array<double>, y array<double>").repartition(5)
    q = base.where("id < 40").selectExpr("id AS qid", "x", "y", "0.5D AS alpha")
    got = {(g.qid, g["rank"]): g.id for g in knn.exact_dual_knn(base, q, 7, digits=6).collect()}
    for i in range(40):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6)
        want = [j for j in np.lexsort((np.arange(300), d)).tolist() if j != i][:7]
        assert [got[i, k] for k in range(1, 8)] == want


def test_matched_recall_covers_points_that_equal_the_target(spark):
    rows = [("last", 1, 0.97, 5.0), ("last", 2, 0.95, 3.0), ("one", 1, 0.95, 4.0), ("up", 1, 0.9, 1.0), ("up", 2, 1.0, 3.0), ("later", 1, 0.9, 1.0), ("later", 2, 0.99, 2.0), ("later", 3, 0.95, 9.0)]
    got = {r.series: r.cost for r in metrics.matched_recall(spark.createDataFrame(rows, "series string, budget int, recall double, cost double"), [0.95]).collect()}
    assert got == {"last": 3.0, "one": 4.0, "up": pytest.approx(2.0), "later": 9.0}
    tied = spark.createDataFrame([("a", 0.96, 2.0, 9, "x"), ("a", 0.97, 2.0, 4, "y"), ("a", 0.99, 3.0, 1, "z")], "series string, recall double, cost double, pages int, label string")
    assert tuple(metrics.work_frontier(tied, [0.95], ties=("pages", "label")).first()) == ("a", 0.95, 2.0, 4, "y")


def test_fixed_pruning_covers_equal_distances():
    v = np.zeros((6, 2))
    pair = lambda i, j: float(np.sqrt(((v[i] - v[j]) ** 2).sum()))
    assert graph.prune_fixed(np.arange(6), np.zeros(6), pair, 4) == [0]


def test_pool_holds_the_results(spark):
    empty = spark.createDataFrame([], "id long, x array<double>, y array<double>")
    with pytest.raises(ValueError, match="pool"):
        search.search(empty, empty, empty, k=10, pool=5)


def test_public_index(spark, points, queries, tmp_path):
    p = points.withColumnRenamed("id", "tag")
    ix = TwinIndex.build(spark, f"file://{tmp_path}/a", p.where("tag < 250"))
    ix.insert(p.where("tag >= 240"))
    ix.remove([5, 7, 251, 99999])
    alive = {r.tag for r in ix.points().collect()}
    assert alive == set(range(300)) - {5, 7, 251}
    got, want = ix.search(queries, 5, 200), ix.exact(queries, 5)
    assert metrics.recall_at_k(got, want, 5).agg(F.avg("recall")).first()[0] >= 90
    again = TwinIndex.load(spark, ix.save(f"file://{tmp_path}/b")._rows.folder)
    assert {r.tag for r in again.points().collect()} == alive
    assert again.evaluate(queries, 5, [50])[0]["recall"] >= 90
    with pytest.raises(FileNotFoundError):
        TwinIndex.load(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="pool"):
        ix.search(queries, 10, 5)


def test_few_rows_left_after_deletions(spark, points, queries, tmp_path):
    ix = TwinIndex.build(spark, f"file://{tmp_path}/c", points.withColumnRenamed("id", "tag"))
    ix.remove(list(range(285)))
    assert {(r.qid, r.n) for r in ix.search(queries.where("qid < 60"), 10, 16).groupBy("qid").agg(F.count("*").alias("n")).collect()} == {(0, 10), (20, 10), (40, 10)}

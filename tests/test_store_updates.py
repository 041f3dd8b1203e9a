import numpy as np
import pytest
from pyspark.sql import functions as F

from twinvec.functions import vector as V
from twinvec.operators import graph, knn, layout, metrics, search, shard, store, updates
from twinvec.plans import fixture as X
from twinvec.sources import vecbin


@pytest.fixture(scope="module")
def points(spark, sf):
    return X.points(spark, sf).select("id", "x", "y").where("id < 240").cache()


@pytest.fixture(scope="module")
def queries(spark, sf):
    return X.queries(spark, sf).select("qid", "x", "y", "alpha").where("qid < 240").cache()


@pytest.fixture(scope="module")
def edges(points):
    return graph.build_dual(points, degree=12, pool=30).cache()


def rows(df):
    return sorted((r.qid, r.rank, r.id, round(r.dist, 9)) for r in df.collect())


def test_half_precision_equals_numpy(spark):
    rng = np.random.default_rng(3)
    values = [0.0, 1.0, -2.0, 8.0, 65504.0, 65519.9, 65520.0, 1e30, 2.0**-24, 2.0**-25, 6.1e-5, 5.96e-8, *(rng.normal(size=400) * 10.0 ** rng.integers(-8, 6, 400)).tolist()]
    got = spark.createDataFrame([(i, float(np.float32(v))) for i, v in enumerate(values)], "i int, v double").select("i", V.fp16_bits(F.col("v")).alias("b")).select("i", "b", V.fp16_value(F.col("b")).alias("v"))
    with np.errstate(over="ignore"):
        want = np.array(values, np.float32).astype(np.float16)
    for r in got.collect():
        assert r.b == int(want[r.i].view(np.uint16)), values[r.i]
        assert r.v == float(want[r.i])


def test_types(spark):
    v = spark.createDataFrame([([1.9, -1.9, 127.0],)], "v array<double>")
    assert v.select(V.convert(F.col("v"), "int8").alias("v")).first().v == [1, -1, 127]
    with pytest.raises(Exception, match="beyond uint8"):
        v.select(V.convert(F.col("v"), "uint8")).collect()
    with pytest.raises(ValueError, match="int9"):
        V.convert(F.col("v"), "int9")
    assert v.select(V.unpad(V.pad(F.col("v")), 3).alias("v")).first().v == [1.9, -1.9, 127.0]
    c = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    assert v.select(V.residual(V.residual(F.col("v"), c), c, subtract=False).alias("v")).first().v == pytest.approx([1.9, -1.9, 127.0])


def test_ways_to_walk_agree(points, edges, queries):
    want = rows(search.search(points, edges, queries, 10, 40))
    assert rows(search.search(points, edges, queries, 10, 40, "batched")) == want
    all_of_it = rows(search.search(points, edges, queries, 10, 240))
    assert rows(search.search(points, edges, queries, 10, 240, "adaptive")) == all_of_it
    seeds = search.sampled_entries(points, queries, 0.2)
    assert rows(search.search(points, edges, queries, 10, 240, seeds=seeds)) == all_of_it


def test_large_indexes_go_by_joins(points, edges, queries, monkeypatch):
    dead = points.where("id % 5 = 2").select("id")
    # One id that asks with two weights.
    twice = queries.union(queries.withColumn("alpha", 1 - F.col("alpha")))
    few = queries.where("qid < 60")
    want, plain = rows(search.search(points, edges, twice.where("qid < 60"), 10, 240, dead=dead)), rows(search.search(points, edges, few, 10, 240))
    assert want and not {r[2] % 5 for r in want} & {2}
    monkeypatch.setattr(search, "MAX_INDEX", 1)
    assert rows(search.search(points, edges, twice.where("qid < 60"), 10, 240, dead=dead)) == want
    assert rows(search.search(points, edges, few, 10, 240)) == plain


def test_large_tables_are_built_by_shards(points, queries, monkeypatch):
    monkeypatch.setattr(graph, "MAX_ROWS", 50)
    monkeypatch.setattr(shard, "BLOCK", 64)
    e = graph.build_dual(points, degree=12, pool=30).cache()
    assert sum(store.edge_violations(e, points, 1000).first()) == 0
    truth = knn.exact_dual_knn(points, queries, 10)
    assert metrics.recall_at_k(search.search(points, e, queries, 10, 64), truth, 10).agg(F.avg("recall")).first()[0] >= 90


def test_layouts_hold_the_same(spark, points, edges, tmp_path):
    want = sorted((r.src, r.pos, r.dst, len(r.ranges)) for r in edges.collect())
    for kind in ("S_TD", "T_XY", "TX_Y", "TY_X"):
        store.save(f"{tmp_path}/{kind}", points, edges, kind=kind, degree=12, pages=4)
        s = store.load(spark, f"{tmp_path}/{kind}")
        assert s.meta["n"] == 240 and s.meta["dx"] == 32 and s.points.count() == 240
        assert sorted((r.src, r.pos, r.dst, len(r.ranges)) for r in s.edges.collect()) == want
    rows = store.sidecar(edges.where("pos = 1"))
    s = store.load(spark, f"{tmp_path}/T_XY", sidecar=rows)
    assert {len(r.ranges) for r in s.edges.where("pos > 1").collect()} == {0}  # serve all weights


def test_sidecar_rules(spark):
    e = spark.createDataFrame([(0, None), (1, []), (2, [(0, 0)]), (3, [(10, 20), (40, 60)]), (4, [(80, 90), (40, 60)]), (5, [(0, 0), (40, 60)])], f"i int, r {store.HUNDREDTHS}")
    assert [r[0] for r in e.orderBy("i").select(store.sidecar_active(F.col("r"), F.lit(0.5))).collect()] == [True, False, False, True, False, False]


def test_violations_are_counted(spark):
    nodes = spark.createDataFrame([(0,), (1,)], "id long")
    e = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 4, 1), (1, 1, 9)], "src long, pos long, dst long")
    assert store.edge_violations(e, nodes, 2).first().asDict() == {"loops": 1, "repeats": 1, "unknown": 1, "gaps": 1, "beyond": 1}
    r = spark.createDataFrame([([(0.1, 0.2)], [(10, 20)]), ([(0.1, 0.25)], [(10, 20)]), ([], [(30, 20)]), ([], [(0, 0), (10, 20)]), ([], [(50, 60), (10, 20)])],
                              f"ranges array<struct<lo:double,hi:double>>, slots {store.HUNDREDTHS}")
    assert store.range_violations(r).first().asDict() == {"wrong": 1, "unsorted": 1, "after_end": 1, "narrowed": 1}


def test_deletions_prune_the_crowded(spark, points):
    p = points.select("id", F.col("x").alias("vec"))
    g, dead = graph.knn_graph(p, 8).cache(), points.where("id % 3 = 0").select("id")
    e = updates.delete_in_place(g, dead, 8, p, sampled=6).cache()
    assert sum(store.edge_violations(e, points.join(dead, "id", "left_anti"), 8).first()) == 0
    merged, ids = updates.merge_deletes(g, dead, 8, p, sampled=6)
    assert merged.count() == e.count() and ids.agg(F.max("new_id")).first()[0] == ids.count() - 1
    assert updates.next_entry(g, dead, 1) == 1
    near = [r.dst for r in g.where("src = 3").orderBy("pos").collect() if r.dst % 3]
    assert updates.next_entry(g, dead, 3) == near[0]


def test_inserted_rows_are_found(points, queries):
    old, new = points.where("id >= 40"), points.where("id < 40")
    e = updates.insert_rows(old, graph.build_dual(old, 12, 30), new, 12, 30)
    assert sum(store.edge_violations(e, points, 1000).first()) == 0
    truth = knn.exact_dual_knn(points, queries, 10)
    assert metrics.recall_at_k(search.search(points, e, queries, 10, 64), truth, 10).agg(F.avg("recall")).first()[0] >= 90


def test_traces(spark, tmp_path):
    updates.write_trace(f"{tmp_path}/t", [3, 4], [7, 8])
    assert [tuple(r) for r in updates.read_trace(spark, f"{tmp_path}/t").orderBy("seq").collect()] == [(0, "delete", 3), (1, "delete", 4), (2, "insert", 7), (3, "insert", 8)]
    (tmp_path / "bad").write_bytes(b"\x05\0\0\0\0")
    with pytest.raises(ValueError, match="no trace"):
        updates.read_trace(spark, f"{tmp_path}/bad")


def test_statistics(spark):
    assert metrics.valid_pools([5, 10, 40], 10) == [10, 40]
    s = spark.createDataFrame([("a", float(v), 2) for v in range(1, 11)], "run string, us double, ios int")
    r = metrics.latency_summary(s, "run", "us", ("ios",), shares=(0.5, 0.999), threads=2).first()
    assert (r.queries, r.mean, r.mean_ios, r.p50, r.p99_9) == (10, 5.5, 2.0, 6.0, 10.0) and r.qps == pytest.approx(2e7 / 55)
    with pytest.raises(ValueError, match="method"):
        metrics.candidate_budget("most", F.lit(0.5), 10)


def test_appended_rows(spark):
    a, b = (spark.createDataFrame([(i, [float(i)]) for i in ids], "id long, vec array<double>") for ids in ((0, 1), (5, 9)))
    assert [(r.id, r.vec) for r in vecbin.append_rows(a, b).orderBy("id").collect()] == [(0, [0.0]), (1, [1.0]), (2, [5.0]), (3, [9.0])]


def test_many_queries_meet_rows_in_tasks(points, monkeypatch):
    q = points.select(F.col("id").alias("qid"), "x", "y", F.explode(F.array(F.lit(0.2), F.lit(0.7))).alias("alpha"))
    put = lambda df: sorted((r.qid, r.alpha, r.rank, r.id, r.dist) for r in df.collect())
    want = put(knn.exact_dual_knn(points, q, 5, digits=9))
    monkeypatch.setattr(knn, "SHIPPED", 10)
    monkeypatch.setattr(knn, "ROW_BLOCK", 100)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 32)
    assert put(knn.exact_dual_knn(points, q, 5, digits=9)) == want
    assert put(knn.exact_dual_knn(points.where("id < 0"), q, 5)) == []


def test_pages_by_ranked_edges(spark):
    e = spark.createDataFrame([(0, 1, 9.0), (2, 3, 8.0), (1, 2, 7.0), (4, 5, 6.0), (5, 6, 5.0), (6, 0, 4.0), (7, 7, 3.0)], "src long, dst long, weight double")
    got = {}
    for r in layout.ranked_pages(e, 4).collect():
        got.setdefault(r.page_id, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_overlapping_shards_make_one_graph(points, spark):
    p = points.select("id", F.col("x").alias("vec"))
    e = shard.build_single_sharded(p, 100, 18, 30).cache()
    assert sum(store.edge_violations(e, points, 18).first()) == 0
    g = e.withColumn("ranges", F.array().cast("array<struct<lo:double,hi:double>>"))
    q = points.where("id % 20 = 0").select(F.col("id").alias("qid"), "x", "y", F.lit(1.0).alias("alpha"))
    truth = knn.exact_dual_knn(points, q, 10)
    assert metrics.recall_at_k(search.search(points, g, q, 10, 64), truth, 10).agg(F.avg("recall")).first()[0] >= 90


def test_ids_and_normalised_files(spark, tmp_path):
    d = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "id long, vec array<double>")
    vecbin.write_vectors(d, f"{tmp_path}/n", kind="fvecs", normalise=True)
    assert np.allclose([r.vec for r in vecbin.read_vectors(spark, f"{tmp_path}/n", kind="fvecs").orderBy("id").collect()], [[0.6, 0.8], [0, 0]])
    vecbin.write_vectors(spark.createDataFrame([(0, [7.0]), (1, [9.0])], "id long, vec array<double>"), f"{tmp_path}/i", "int32")
    assert [tuple(r) for r in vecbin.read_ids(spark, f"{tmp_path}/i").orderBy("local").collect()] == [(0, 7), (1, 9)]


def test_orders_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(layout, "RANGE_ROWS", 50)
    d = spark.range(500).select("id", F.pmod(F.xxhash64("id"), F.lit(97)).alias("key"))
    want = sorted((r.key, r.id) for r in d.collect())
    got = {r.id: (r.page_id, r.slot) for r in layout.assign_pages(d, 7, "key").collect()}
    assert got == {i: divmod(at, 7) for at, (_, i) in enumerate(want)}
    for p in (0.0, 0.3, 0.999, 1.0):
        assert metrics.percentile_floor(d, "key", p).first().value == want[min(int(p * 500), 499)][0]
    assert metrics.percentile_floor(d.where("id < 0"), "key", 0.5).first().value is None


def test_copies_do_not_cut_a_graph(spark, points, queries, tmp_path):
    """Four copies of each row: what leads to one leads to all, also after inserts, removals and compaction."""
    from twinvec.index import TwinIndex

    some = points.where("id < 120")
    p = some.crossJoin(spark.range(4).select(F.col("id").alias("s"))).select((F.col("id") + 120 * F.col("s")).alias("tag"), "x", "y")
    q = queries.where("qid < 120")
    ix = TwinIndex.build(spark, f"file://{tmp_path}/copies", p.where("tag % 5 <> 1"))
    assert rows(ix.search(q, 10, 64)) == rows(ix.exact(q, 10))
    ix.insert(p.where("tag % 5 = 1"))
    ix.remove(p.where("tag % 7 = 3").select("tag"))
    ix.compact()
    assert rows(ix.search(q, 10, 64)) == rows(ix.exact(q, 10))


def test_copies_in_blocks_that_meet(spark, points, monkeypatch):
    monkeypatch.setattr(knn, "SHIPPED", 8)
    p = points.where("id < 40").crossJoin(spark.range(2).select(F.col("id").alias("s"))).select((F.col("id") + 40 * F.col("s")).alias("id"), "x", "y")
    e = {(r.src, r.dst) for r in graph.build_dual(p, 6, 10).select("src", "dst").collect()}
    assert {(i, i + 40) for i in range(40)} <= e and {a for a, _ in e} == set(range(80))


def test_an_index_passes_the_driver_as_arrays(points, edges, queries, monkeypatch):
    """Rows as objects take many times an index's size."""
    monkeypatch.setattr(type(points), "toPandas", None)
    assert search.search(points, edges, queries, 10, 64).count() == 120
    assert search.trace(points, edges, queries).count() > 0


def test_codes_of_blocks_of_rows(points, edges, queries, monkeypatch):
    want = rows(search.search(points, edges, queries, 10, 64, "rerank"))
    monkeypatch.setattr(search, "CODED", 50)
    assert rows(search.search(points, edges, queries, 10, 64, "rerank")) == want


def test_shards_grow_by_more_than_one(points, monkeypatch):
    """A row among many shards is assigned a few times, not once for each further shard."""
    calls = []
    monkeypatch.setattr(shard, "kmeans_centers", lambda p, k, seed, f=shard.kmeans_centers: calls.append(k) or f(p, k, seed))
    got = shard.partition_with_budget(points.select("id", F.col("x").alias("vec")), 12, copies=2)
    assert len(calls) <= 9 and calls[0] == 40 and max(r["count"] for r in got.groupBy("cid", "part").count().collect()) <= 24
    assert got.groupBy("id").count().where("count = 2").count() == 240


def test_index_finds_nine_tenths_by_widening_its_pool(spark, points, queries, tmp_path):
    from twinvec.index import TwinIndex

    ix = TwinIndex.build(spark, f"file://{tmp_path}/ix", points.withColumnRenamed("id", "tag").coalesce(1), degree=1, pool=2)
    truth = ix.exact(queries, 10).cache()
    recall = [metrics.recall_at_k(ix.search(queries, 10, 10, r), truth, 10).agg(F.avg("recall")).first()[0] for r in (None, 90.0)]
    assert recall[0] < 85 and recall[1] >= 90, recall


def test_many_walks_at_once_find_what_each_does():
    rng, n, each = np.random.default_rng(5), 100, 9
    x, y = rng.normal(size=(n, 5)), rng.normal(size=(n, 4))
    x[40:60], y[40:60] = x[40], y[40]
    dst = np.concatenate([rng.permutation(n)[:each] for _ in range(n)])
    ranges = rng.integers(0, 3, n * each)
    lo = rng.random(ranges.sum()) * 0.6
    ix = search.Index({"id": np.arange(n) * 3, "x": x.ravel(), "y": y.ravel()}, {"src": np.repeat(np.arange(n) * 3, each), "pos": np.tile(np.arange(each), n), "dst": dst * 3, "n": ranges, "lo": lo, "hi": lo + 0.4})
    alpha, seeds = np.arange(40) % 11 / 10, [np.arange(i % 3) * 7 for i in range(40)]
    for filtered in (True, False):
        for pool in (1, 12, 120):
            d, nodes = search.walk_many(ix, x[:40], y[:40], alpha, seeds, pool, filtered=filtered)
            for i in range(40):
                assert [(a, b) for a, b in zip(d[i].tolist(), nodes[i].tolist(), strict=True) if b >= 0] == search.walk(ix, x[i], y[i], alpha[i], pool, filtered=filtered, seeds=seeds[i])

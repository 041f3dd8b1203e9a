"""Building by tasks that hold all vectors, and the search by joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinvec.operators import graph, knn, search, skyline
from twinvec.scratch import written

N = 260


def _vectors(kind: str):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(N, 6)), rng.normal(size=(N, 6))
    if kind == "ties":
        x, y = np.round(x[:, :2]), np.round(y[:, :3])
    if kind == "near copies":  # far from the origin, and nearer to each other than single precision tells
        x, y = 3 + x * 1e-7, np.repeat(y[:4], N // 4, axis=0) * 50 + y * 1e-6
    return x, y


@pytest.fixture(scope="module")
def points(spark):
    x, y = _vectors("plain")
    x[N - 20 :], y[N - 20 :] = x[:20], y[:20]
    return written(spark.createDataFrame([(i * 3, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y array<double>").repartition(3), "points")


def _rows(df):
    return sorted(df.select("src", "pos", "dst", "d1", "d2", "layer", "ranges").collect())


def test_graph_is_built_without_moving_vectors(points, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(graph, "MAX_HELD", 0)
        by_joins = _rows(graph.build_dual(points, 6, 15))
    refuse = lambda *a, **b: pytest.fail("vectors moved")
    monkeypatch.setattr(knn, "exact_dual_knn", refuse)
    monkeypatch.setattr(graph, "dual_edges", refuse)
    assert _rows(graph.build_dual(points, 6, 15)) == by_joins


def test_edges_are_chosen_without_moving_vectors(spark, points, monkeypatch):
    """Also with candidates that are no rows, or the source itself."""
    c = spark.range(N).select((F.col("id") * 3).alias("src"), F.explode(F.array(*[(F.col("id") * 3 + i * i * 5) % (3 * N + 9) for i in range(20)])).alias("dst"))
    with monkeypatch.context() as m:
        m.setattr(graph, "MAX_HELD", 0)
        by_joins = _rows(graph.dual_edges(c, points, 5))
    got = graph.dual_edges(c, points, 5)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert _rows(got) == by_joins


@pytest.mark.parametrize("kind", ("plain", "ties", "near copies"))
@pytest.mark.parametrize("chunk", (64, 2048))
def test_many_rows_at_once_choose_what_each_does(kind, chunk, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    (x, y), ids, at = _vectors(kind), np.arange(N) * 7, np.arange(0, N, 3)
    near = graph.nearest_together(graph.Expanded(x), graph.Expanded(y), at, 12)
    for a, got in zip(at, near, strict=True):
        dx, dy = (np.sqrt(((m - m[a]) ** 2).sum(1)) for m in (x, y))
        dx[a] = dy[a] = np.inf
        assert got.tolist() == sorted({i for w in graph.ALPHAS for i in np.argsort((w * dx if w else 0) + ((1 - w) * dy if w < 1 else 0), kind="stable")[:12].tolist()})
    for options in ({}, {"hard": True}, {"relax": 1.1, "min_width": 0.02}):
        got = graph.prune_together(at, near, ids, x, y, 5, **options)
        ends = np.cumsum(got["n"])
        rows = [(*r, list(zip(got["lo"][e - k : e].tolist(), got["hi"][e - k : e].tolist(), strict=True))) for *r, k, e in zip(*(got[c].tolist() for c in ("src", "pos", "dst", "layer", "n")), ends.tolist(), strict=True)]
        want = []
        for a, c in zip(at, near, strict=True):
            chosen = graph.prune_dual(ids[c], graph._apart(x[[a]], x[c]), graph._apart(y[[a]], y[c]), x[c], y[c], 5, **options)
            want += [(a, i + 1, c[j], layer, left) for i, (j, layer, left) in enumerate(chosen)]
        assert rows == want


def _plain(ix, entries, qid, qx, qy, alpha, k, pool):
    """The search by joins, for one query, with a set of all that was seen."""
    score = lambda n: float(ix.exact(np.array([n]), qx, qy, alpha)[0][0])
    found, done, seen = {n: score(n) for n in entries}, set(), set(entries)
    while True:
        kept = sorted((d, n) for n, d in found.items())[:pool]
        found = {n: d for d, n in kept}
        front = [n for n in found if n not in done]
        if not front:
            return [int(ix.ids[n]) for _, n in kept if ix.ids[n] != qid][:k]
        done.update(front)
        new = {n for f in front for n in ix.neighbours(f, alpha).tolist()} - seen
        seen |= new
        found |= {n: score(n) for n in new}


@pytest.mark.parametrize("rows", (1 << 14, 60))
def test_joins_write_pools_alone_and_find_what_a_plain_search_finds(points, monkeypatch, rows):
    monkeypatch.setattr(search, "FRAME_ROWS", rows)
    monkeypatch.setattr(search, "FRAME_QUERIES", rows // 4)
    edges = written(graph.build_dual(points, 6, 15), "edges")
    queries = points.where("id % 4 = 0").select(F.col("id").alias("qid"), "x", "y", (F.col("id") % 11 / 10.0).alias("alpha"))
    labels, write = [], search.written
    monkeypatch.setattr(search, "written", lambda df, label="t", files=None: labels.append(label) or write(df, label, files))
    got = search.search_frames(points, edges, queries, 5, pool=12)
    assert set(labels) == {"points", "edges", "queries", "pool"}
    assert dict(got.dtypes) == {"qid": "bigint", "rank": "bigint", "id": "bigint", "dist": "double"}
    ix = search.Index(search._packed(points, search._point_arrays), search._packed(edges.select("src", "pos", "dst", "ranges"), search._edge_arrays))
    far = skyline.entry_points(graph.to_centres(points, graph.centroids(points)), "dx2", "dy2")
    entries = ix.places([r.id for r in far.collect()]).tolist()
    want = {(r.qid, i + 1, n) for r in queries.collect() for i, n in enumerate(_plain(ix, entries, r.qid, np.array(r.x), np.array(r.y), r.alpha, 5, 12))}
    assert {(r.qid, r["rank"], r.id) for r in got.collect()} == want


def test_joins_leave_out_what_has_no_distance(spark, points):
    odd = points.union(spark.createDataFrame([(1, None, [0.0] * 6), (2, [0.0] * 5, [0.0] * 6)], points.schema))
    edges = spark.createDataFrame([(0, 1, []), (0, 2, []), (0, 3, []), (0, 5, [])], "src long, dst long, ranges array<struct<lo:double,hi:double>>")
    queries = points.where("id = 0").select(F.col("id").alias("qid"), "x", "y", F.lit(0.5).alias("alpha"))
    got = search.search_frames(odd, edges, queries, 500, pool=500, seeds=queries.select("qid", F.col("qid").alias("id")))
    found = {r.id for r in got.collect()}
    assert 3 in found and not {0, 1, 2, 5} & found

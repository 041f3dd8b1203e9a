"""The registered queries of the similarity engine and their SQL."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinvec.functions import intervals as R
from twinvec.functions import vector as V
from twinvec.operators import graph, knn, layout, metrics, pq, search, shard, skyline, store, updates
from twinvec.plans import fixture as X
from twinvec.scratch import shared_dir, written
from twinvec.streaming import dynamic

K, DIGITS = 10, 6
_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _r(c, digits: int = DIGITS):
    return F.round(c, digits) + 0.0


def _pairs(spark, sf_dir, spaces, emit, schema, done=None) -> DataFrame:
    """The stated queries against all rows, by blocks."""
    return knn.pairs(X.points(spark, sf_dir).select("id", *spaces), X.queries(spark, sf_dir).select("qid", "alpha", *spaces), spaces, emit, schema, done)


def _cells(block, known, **columns) -> dict:
    """A row for each query and other row of a block; columns are null where they are not known."""
    i, j = np.nonzero(block.other)
    values = {c: pa.array(knn.half_up(v, DIGITS)[i, j], mask=~known[i, j]) for c, v in columns.items()}
    return {"qid": block.qid[i], "id": block.ids[j]} | values


def _rank(expr: str, extra: str = "") -> str:
    return f"""WITH {X.SQL} SELECT qid, rank, id, dist FROM (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank
FROM (SELECT qid, id, round({expr}, 6) AS dist FROM d {extra})) WHERE rank <= {K}"""


_FUSED = "alpha * sqrt(dx2) + (1 - alpha) * sqrt(dy2)"


# Scalar and vector functions


@query(f"WITH {X.SQL} SELECT qid, id, round(dx2, 6) AS dx2, round(sqrt(dy2), 6) AS dy FROM d")
def l2_pairs(spark, sf_dir):
    def emit(block):
        dx2, dy = block.squares("x"), np.sqrt(block.squares("y"))
        out = _cells(block, block.known("x"), dx2=dx2)
        return out | {"dy": _cells(block, block.known("y"), dy=dy)["dy"]}

    return _pairs(spark, sf_dir, ("x", "y"), emit, "qid long, id long, dx2 double, dy double")


@query(f"WITH {X.SQL} SELECT qid, id, round(list_cosine_similarity(qe, e), 6) + 0.0 AS similarity, round(1 - list_cosine_similarity(qe, e), 6) AS distance FROM q, v WHERE qid <> id")
def cosine_pairs(spark, sf_dir):
    def emit(block):
        a, b = block.norms("e")
        n = a[:, None] * b[None, :]
        s = np.where(n > 0, block.dots("e") / n, 0.0)
        return _cells(block, block.known("e"), similarity=s, distance=1 - s)

    return _pairs(spark, sf_dir, ("e",), emit, "qid long, id long, similarity double, distance double")


@query(f"""WITH {X.SQL}, n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda t: t * t))) AS norm FROM v)
SELECT id, CAST(i AS BIGINT) AS pos, round(e[i] / norm, 6) + 0.0 AS value, round(norm, 6) AS norm FROM n, range(1, 65) t(i)""")
def normalize(spark, sf_dir):
    p = X.points(spark, sf_dir).withColumn("norm", V.norm(F.col("e")))
    p = p.select("id", "norm", F.posexplode(V.l2_normalize(F.col("e"))).alias("pos", "value"))
    return p.select("id", (F.col("pos") + 1).cast("long").alias("pos"), _r(F.col("value")).alias("value"), _r(F.col("norm")).alias("norm"))


@query(f"WITH {X.SQL} SELECT qid, id, round(alpha * sqrt(dx2) / ({_FUSED}), 6) AS share FROM d")
def contribution_share(spark, sf_dir):
    def emit(block):
        dx = block.alpha * np.sqrt(block.squares("x"))
        total = dx + (1 - block.alpha) * np.sqrt(block.squares("y"))
        return _cells(block, block.known("x", "y") & (total > 0), share=dx / total)

    return _pairs(spark, sf_dir, ("x", "y"), emit, "qid long, id long, share double")


# Exact search


@query(_rank(_FUSED))
def fused_topk_mixed_alpha(spark, sf_dir):
    return knn.exact_dual_knn(X.points(spark, sf_dir), X.queries(spark, sf_dir), K, "fused", digits=DIGITS).select("qid", "rank", "id", "dist")


@query(_rank("alpha * dx2 + (1 - alpha) * dy2"))
def legacy_sq_topk(spark, sf_dir):
    return knn.exact_dual_knn(X.points(spark, sf_dir), X.queries(spark, sf_dir), K, "fused_sq", digits=DIGITS).select("qid", "rank", "id", "dist")


@query(_rank("sqrt(dx2)"))
def x_only_topk(spark, sf_dir):
    return knn.exact_dual_knn(X.points(spark, sf_dir), X.queries(spark, sf_dir), K, "x", digits=DIGITS).select("qid", "rank", "id", "dist")


@query(_rank("sqrt(dy2)"))
def y_only_topk(spark, sf_dir):
    return knn.exact_dual_knn(X.points(spark, sf_dir), X.queries(spark, sf_dir), K, "y", digits=DIGITS).select("qid", "rank", "id", "dist")


@query(_rank("sqrt(dx2 + dy2)"))
def concat_topk(spark, sf_dir):
    return knn.exact_dual_knn(X.points(spark, sf_dir), X.queries(spark, sf_dir), K, "concat", digits=DIGITS).select("qid", "rank", "id", "dist")


_GRID = f"""WITH {X.SQL}, g AS (SELECT qid, id, CAST(a AS DOUBLE) / 10 AS alpha, dx2, dy2 FROM d, range(0, 11) t(a))
SELECT qid, alpha, rank, id, dist FROM (SELECT qid, alpha, id, dist, row_number() OVER (PARTITION BY qid, alpha ORDER BY dist, id) AS rank
FROM (SELECT qid, alpha, id, round({_FUSED}, 6) AS dist FROM g)) WHERE rank <= {K}"""


@query(_GRID)
def fused_topk_fixed_alpha_grid(spark, sf_dir):
    q = X.queries(spark, sf_dir).drop("alpha").withColumn("alpha", F.explode(F.array(*[F.lit(a / 10.0) for a in range(11)])))
    return knn.exact_dual_knn(X.points(spark, sf_dir), q, K, "fused", digits=DIGITS)


@query(_rank(_FUSED, "WHERE id % 7 <> 3"))
def tombstone_filtered_topk(spark, sf_dir):
    p = X.points(spark, sf_dir)
    dead = p.where("id % 7 = 3").select("id")
    return knn.exact_dual_knn(p.join(dead, "id", "left_anti"), X.queries(spark, sf_dir), K, "fused", digits=DIGITS).select("qid", "rank", "id", "dist")


@query(f"""WITH {X.SQL}, f AS (SELECT qid, id, round({_FUSED}, 6) AS dist FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM f),
t AS (SELECT * FROM r WHERE rank <= 100), w AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM t WHERE id BETWEEN 100 AND 399)
SELECT qid, rank, id, dist FROM w WHERE rank <= {K}""")
def gt_window(spark, sf_dir):
    truth = knn.exact_dual_knn(X.points(spark, sf_dir), X.queries(spark, sf_dir), 100, "fused", digits=DIGITS)
    return search.truth_window(truth, 100, 400, K).select("qid", "rank", "id", "dist")


@query(f"""WITH {X.SQL}, f AS (SELECT qid, id, round({_FUSED}, 6) AS dist, dx2, dy2 FROM d),
a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sqrt(dx2), 12), id) AS rx, row_number() OVER (PARTITION BY qid ORDER BY round(sqrt(dy2), 12), id) AS ry FROM f)
SELECT qid, rank, id, dist FROM (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM a WHERE rx <= 20 OR ry <= 20) WHERE rank <= {K}""")
def dual_union_rerank(spark, sf_dir):
    return knn.dual_union_rerank(X.points(spark, sf_dir), X.queries(spark, sf_dir), K, 20, 20, DIGITS)


# Aggregates, medoids, skylines


@query(f"""WITH {X.SQL}, u AS (SELECT 'x' AS space, i AS pos, x[i] AS val FROM v, range(1, 33) t(i) UNION ALL SELECT 'y', i, y[i] FROM v, range(1, 33) t(i))
SELECT space, CAST(pos AS BIGINT) AS pos, round(avg(val), 6) + 0.0 AS value FROM u GROUP BY space, pos""")
def centroids(spark, sf_dir):
    c = graph.centroids(X.points(spark, sf_dir))
    return c.select("space", F.posexplode("centroid").alias("p", "v")).select("space", (F.col("p") + 1).cast("long").alias("pos"), _r(F.col("v")).alias("value"))


_MEANS = "m AS (SELECT list(ax ORDER BY i) AS cx, list(ay ORDER BY i) AS cy FROM (SELECT i, avg(x[i]) AS ax, avg(y[i]) AS ay FROM v, range(1, 33) t(i) GROUP BY i))"


@query(f"""WITH {X.SQL}, {_MEANS}, f AS (SELECT 'x' AS space, id, round({X.sql_sq("cx", "x")}, 6) AS d2 FROM v, m UNION ALL SELECT 'y', id, round({X.sql_sq("cy", "y")}, 6) FROM v, m)
SELECT space, id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY d2, id) AS r FROM f) WHERE r = 1""")
def medoid(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return graph.medoids(p, graph.centroids(p), DIGITS)


_LAYER0 = f"""WITH {X.SQL}, s AS (SELECT qid, id, round(dx2, 6) AS d1, round(dy2, 6) AS d2 FROM d)
SELECT qid, id, d1, d2 FROM (SELECT *, min(d1) OVER (PARTITION BY qid ORDER BY d2, d1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) WHERE m IS NULL OR d1 < m"""


@query(_LAYER0)
def skyline_layer0(spark, sf_dir):
    return skyline.nearest_skyline(X.points(spark, sf_dir), X.queries(spark, sf_dir), DIGITS)


@query(f"""WITH RECURSIVE {X.SQL}, s AS (SELECT qid, id, round(dx2, 6) AS d1, round(dy2, 6) AS d2 FROM d),
dom AS (SELECT a.qid, a.id AS near, b.id AS far FROM s a JOIN s b ON a.qid = b.qid AND a.d1 <= b.d1 AND (a.d2 < b.d2 OR (a.d2 = b.d2 AND (a.d1 < b.d1 OR a.id < b.id)))),
r AS (SELECT qid, id, 0 AS layer FROM s UNION SELECT r.qid, far, layer + 1 FROM r JOIN dom ON r.qid = dom.qid AND r.id = near WHERE layer < 41),
l AS (SELECT qid, id, max(layer) AS layer FROM r GROUP BY qid, id),
n AS (SELECT qid, layer, sum(count(*)) OVER (PARTITION BY qid ORDER BY layer) - count(*) AS before FROM l GROUP BY qid, layer)
SELECT qid, id, d1, d2, CAST(layer AS BIGINT) AS layer FROM s JOIN l USING (qid, id) JOIN n USING (qid, layer) WHERE before < 40""")
def skyline_layers(spark, sf_dir):
    return skyline.nearest_layers(X.points(spark, sf_dir), X.queries(spark, sf_dir), 40, DIGITS)


@query(f"""WITH {X.SQL}, {_MEANS}, s AS (SELECT id, round({X.sql_sq("cx", "x")}, 6) AS d1, round({X.sql_sq("cy", "y")}, 6) AS d2 FROM v, m)
SELECT id, d1, d2 FROM (SELECT *, max(d1) OVER (ORDER BY d2 DESC, d1 DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) WHERE (m IS NULL AND d1 > 0) OR d1 > m""")
def entry_points(spark, sf_dir):
    p = X.points(spark, sf_dir)
    d = graph.to_centres(p, graph.centroids(p)).select("id", _r(F.col("dx2")).alias("d1"), _r(F.col("dy2")).alias("d2"))
    return skyline.entry_points(d)


# Graphs

_KNN = f"""{X.SQL}, kd AS (SELECT a.id AS src, b.id AS dst, round(sqrt({X.sql_sq("a.x", "b.x")}), 6) AS dist FROM v a, v b WHERE a.id <> b.id),
kg AS (SELECT src, pos, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS pos FROM kd) WHERE pos <= {K})"""


def _graph(spark, sf_dir) -> DataFrame:
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    return graph.knn_graph(p, K, DIGITS)


@query(f"WITH {_KNN} SELECT src, pos, dst, dist FROM kg")
def knn_graph(spark, sf_dir):
    return _graph(spark, sf_dir)


@query(f"WITH {_KNN} SELECT dst AS src, row_number() OVER (PARTITION BY dst ORDER BY dist, src) AS pos, src AS dst, dist FROM kg")
def reverse_edges(spark, sf_dir):
    return graph.reverse_edges(_graph(spark, sf_dir))


@query(f"""WITH {_KNN}, u AS (SELECT src, dst FROM kg UNION SELECT dst, src FROM kg), n AS (SELECT src, count(*) AS n FROM u GROUP BY src)
SELECT max(n) AS most, min(n) AS least, round(avg(n), 6) AS mean, count(*) FILTER (n < 2) AS under_two FROM n""")
def degree_stats(spark, sf_dir):
    g = _graph(spark, sf_dir).select("src", "dst")
    return graph.degree_stats(g.union(g.select("dst", "src")).distinct())


@query(f"WITH {_KNN} SELECT s.src, a.dst, min(s.pos) AS pos FROM (SELECT src, src AS at, 0 AS pos FROM kg WHERE src % 20 = 0 AND pos = 1) s JOIN kg a ON s.at = a.src GROUP BY s.src, a.dst")
def one_hop_expand(spark, sf_dir):
    f = X.queries(spark, sf_dir).select(F.col("qid").alias("src"), F.col("qid").alias("at"), F.lit(0).cast("long").alias("pos"))
    return graph.expand(f, _graph(spark, sf_dir).select(F.col("src").alias("at"), "dst")).select("src", "dst", F.col("pos").cast("int").alias("pos"))


@query(f"""WITH {_KNN} SELECT DISTINCT a.src, b.dst FROM kg a JOIN kg b ON a.dst = b.src WHERE a.src % 20 = 0 AND b.dst <> a.src
AND NOT EXISTS (SELECT 1 FROM kg c WHERE c.src = a.src AND c.dst = b.dst)""")
def two_hop_expand(spark, sf_dir):
    return graph.two_hops(_graph(spark, sf_dir), X.queries(spark, sf_dir).select(F.col("qid").alias("src")))


@query(f"""WITH {_KNN}, dead AS (SELECT id FROM v WHERE id % 7 = 3), live AS (SELECT src, dst FROM kg WHERE src % 7 <> 3)
SELECT DISTINCT src, dst FROM (SELECT src, dst FROM live WHERE dst % 7 <> 3 UNION ALL
SELECT l.src, k.dst FROM live l JOIN kg k ON l.dst = k.src WHERE l.dst % 7 = 3 AND k.dst % 7 <> 3) WHERE src <> dst""")
def delete_splice(spark, sf_dir):
    dead = X.points(spark, sf_dir).where("id % 7 = 3").select("id")
    return graph.splice(_graph(spark, sf_dir).select("src", "dst"), dead)


# Intervals


@query("""WITH h AS (SELECT vec_id AS id, CAST(vec_id % 9 - 4 AS DOUBLE) AS slope, CAST(vec_id * 7 % 11 - 5 AS DOUBLE) / 2 AS rhs FROM embeddings)
SELECT id, CASE WHEN slope = 0 AND rhs >= 0 THEN 0.0 WHEN slope > 0 AND rhs >= 0 THEN 0.0 WHEN slope < 0 AND rhs / slope <= 1 THEN greatest(0.0, rhs / slope) END + 0.0 AS lo,
CASE WHEN slope = 0 AND rhs >= 0 THEN 1.0 WHEN slope > 0 AND rhs >= 0 THEN least(1.0, rhs / slope) WHEN slope < 0 AND rhs / slope <= 1 THEN 1.0 END + 0.0 AS hi FROM h""")
def occlusion_halfplane(spark, sf_dir):
    h = X.points(spark, sf_dir).select("id", (F.col("id") % 9 - 4).cast("double").alias("slope"), ((F.col("id") * 7 % 11 - 5) / 2.0).alias("rhs"))
    s = R.half_plane(F.col("slope"), F.col("rhs"))
    return h.select("id", (s["lo"] + 0.0).alias("lo"), (s["hi"] + 0.0).alias("hi"))


def _exploded(df: DataFrame, c) -> DataFrame:
    return df.select("id", F.explode(c).alias("r")).select("id", _r(F.col("r.lo")).alias("lo"), _r(F.col("r.hi")).alias("hi"))


@query(f"WITH {X.SQL_INTERVALS} SELECT id, greatest(lo, 0.3) AS lo, least(hi, 0.7) AS hi FROM iv WHERE greatest(lo, 0.3) < least(hi, 0.7)")
def interval_intersect(spark, sf_dir):
    return _exploded(X.intervals(spark, sf_dir), R.intersect(F.col("ranges"), F.lit(0.3), F.lit(0.7)))


@query(f"WITH {X.SQL_INTERVALS} SELECT id, lo, hi FROM un")
def interval_union(spark, sf_dir):
    return _exploded(X.intervals(spark, sf_dir), R.union(F.col("ranges")))


@query(f"""WITH {X.SQL_INTERVALS}, e AS (SELECT id, coalesce(lag(hi) OVER (PARTITION BY id ORDER BY lo), 0.0) AS lo, lo AS hi FROM un UNION ALL SELECT id, max(hi), 1.0 FROM un GROUP BY id)
SELECT id, lo, hi FROM e WHERE round(hi - lo, 9) >= 0.01""")
def interval_complement(spark, sf_dir):
    return _exploded(X.intervals(spark, sf_dir), R.complement(F.col("ranges")))


@query(f"WITH {X.SQL_INTERVALS} SELECT id, round(sum(hi - lo), 6) AS width FROM un GROUP BY id")
def interval_width(spark, sf_dir):
    return X.intervals(spark, sf_dir).select("id", _r(R.width(F.col("ranges"))).alias("width"))


@query(f"WITH {X.SQL_INTERVALS} SELECT id, CAST(floor(round(lo * 33.37, 9)) AS TINYINT) AS lo, CAST(ceil(round(hi * 33.37, 9)) AS TINYINT) AS hi FROM iv")
def quantize_outward(spark, sf_dir):
    third = F.transform("ranges", lambda r: R.span(r.lo * 0.3337, r.hi * 0.3337))
    return X.intervals(spark, sf_dir).select("id", F.explode(R.quantize(third)).alias("r")).select("id", "r.lo", "r.hi")


def _compressed(first: str) -> str:
    return f"""WITH {X.SQL_INTERVALS}, g AS (SELECT id, lo, hi, row_number() OVER (PARTITION BY id ORDER BY lo) AS i, lag(hi) OVER (PARTITION BY id ORDER BY lo) AS before FROM un),
c AS (SELECT id, i AS cut FROM (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY lo - before DESC, {first}) AS r FROM g WHERE before IS NOT NULL) WHERE r = 1)
SELECT id, min(lo) AS lo, max(hi) AS hi FROM g LEFT JOIN c USING (id) GROUP BY id, coalesce(i >= cut, false)"""


@query(_compressed("i DESC"))
def compress_greedy2(spark, sf_dir):
    return _exploded(X.intervals(spark, sf_dir), R.compress(F.col("ranges"), 2, "gap"))


@query(_compressed("i"))
def compress_maxcover2(spark, sf_dir):
    return _exploded(X.intervals(spark, sf_dir), R.compress(F.col("ranges"), 2, "split"))


@query(f"""WITH {X.SQL_INTERVALS} SELECT vec_id AS id, CAST(vec_id % 11 AS DOUBLE) / 10 AS alpha,
vec_id % 6 = 0 OR EXISTS (SELECT 1 FROM iv WHERE iv.id = vec_id AND round(lo * 100) <= vec_id % 11 * 10 AND vec_id % 11 * 10 <= round(hi * 100)) AS active FROM embeddings""")
def alpha_active_edges(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", ((F.col("id") % 11) / 10.0).alias("alpha")).join(X.intervals(spark, sf_dir), "id", "left")
    ranges = R.quantize(F.coalesce("ranges", R.none()))
    return p.select("id", "alpha", R.active(ranges, F.col("alpha")).alias("active"))


_ACTIVE = f"WITH {X.SQL_INTERVALS} SELECT a AS percent, (SELECT count(*) FROM un WHERE round(lo * 100) <= a AND a <= round(hi * 100)) AS edges FROM range(0, 101) t(a)"


@query(_ACTIVE)
def active_edge_counts(spark, sf_dir):
    u = X.intervals(spark, sf_dir).select("id", F.explode(R.quantize(R.union(F.col("ranges")))).alias("r")).select("r.lo", "r.hi")
    return graph.active_counts(u)


@query(f"WITH {X.SQL_INTERVALS} SELECT id % 11 AS tenth, count(*) AS edges, count(*) FILTER (round(lo * 100) <= id % 11 * 10 AND id % 11 * 10 <= round(hi * 100)) AS active, round(avg(hi - lo), 6) AS mean_width FROM un GROUP BY id % 11")
def activity_by_alpha(spark, sf_dir):
    u = X.intervals(spark, sf_dir).select("id", F.explode(R.union(F.col("ranges"))).alias("r"))
    a, lo, hi = F.col("id") % 11 * 10, F.round(F.col("r.lo") * 100), F.round(F.col("r.hi") * 100)
    return u.groupBy((F.col("id") % 11).alias("tenth")).agg(
        F.count("*").alias("edges"), F.sum(((lo <= a) & (a <= hi)).cast("long")).alias("active"), _r(F.avg(F.col("r.hi") - F.col("r.lo"))).alias("mean_width")
    )


# Metrics

_TOPS = f"""{X.SQL}, f AS (SELECT qid, id, round({_FUSED}, 6) AS dist, round(sqrt(dx2), 6) AS dx, round(sqrt(dy2), 6) AS dy FROM d),
ra AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank, row_number() OVER (PARTITION BY qid ORDER BY dx, id) AS rx, row_number() OVER (PARTITION BY qid ORDER BY dy, id) AS ry FROM f)"""


def _tops(spark, sf_dir, k: int = K):
    p, q = X.points(spark, sf_dir), X.queries(spark, sf_dir)
    return [knn.exact_dual_knn(p, q, n, o, digits=DIGITS).drop("alpha") for o, n in (("fused", 4 * k), ("x", k), ("y", k))]


@query(f"""WITH {_TOPS}, kt AS (SELECT qid, dist AS kth FROM ra WHERE rank = {K}), gold AS (SELECT ra.qid, id FROM ra JOIN kt USING (qid) WHERE rank <= 40 AND (rank <= {K} OR dist <= kth))
SELECT q.qid, CAST(least(count(ra.id), {K}) AS BIGINT) AS hits, CAST(least(count(ra.id), {K}) * 100.0 / {K} AS DOUBLE) AS recall
FROM q LEFT JOIN gold USING (qid) LEFT JOIN ra ON ra.qid = gold.qid AND ra.id = gold.id AND rx <= {K} GROUP BY q.qid""")
def recall_at_k(spark, sf_dir):
    truth, x, _ = _tops(spark, sf_dir)
    return metrics.recall_at_k(x, truth, K)


@query(f"""WITH {_TOPS}, act AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS ar FROM ra WHERE rank <= 40 AND id % 3 <> 0),
kt AS (SELECT qid, dist AS kth FROM act WHERE ar = {K}), gold AS (SELECT act.qid, id FROM act LEFT JOIN kt USING (qid) WHERE ar <= {K} OR dist <= kth)
SELECT q.qid, CAST(least(count(ra.id), {K}) AS BIGINT) AS hits, CAST(least(count(ra.id), {K}) * 100.0 / {K} AS DOUBLE) AS recall
FROM (SELECT DISTINCT qid FROM act) q LEFT JOIN gold USING (qid) LEFT JOIN ra ON ra.qid = gold.qid AND ra.id = gold.id AND rx <= {K} GROUP BY q.qid""")
def recall_at_k_active(spark, sf_dir):
    truth, x, _ = _tops(spark, sf_dir)
    return metrics.recall_at_k(x, truth, K, X.points(spark, sf_dir).where("id % 3 <> 0"))


@query(f"""WITH {_TOPS} SELECT qid, count(*) FILTER (rank <= {K} AND rx <= {K}) AS by_x, count(*) FILTER (rank <= {K} AND ry <= {K}) AS by_y,
count(*) FILTER (rank <= {K} AND (rx <= {K} OR ry <= {K})) AS by_union, count(*) FILTER (rx <= {K} OR ry <= {K}) AS union_size FROM ra GROUP BY qid""")
def coverage_oracle(spark, sf_dir):
    truth, x, y = _tops(spark, sf_dir)
    return metrics.coverage(x, y, truth.where(F.col("rank") <= K)).select("qid", "by_x", "by_y", "by_union", "union_size")


@query("""SELECT CAST(a AS DOUBLE) / 20 AS alpha, CASE WHEN a <= 1 THEN 0 WHEN a >= 19 THEN 20 ELSE a END AS kx, CASE WHEN a <= 1 THEN 20 WHEN a >= 19 THEN 0 ELSE 20 - a END AS ky FROM range(0, 21) t(a)""")
def budget_allocation(spark, sf_dir):
    a = spark.range(21).select((F.col("id") / 20.0).alias("alpha"))
    kx, ky = metrics.budget_split(F.col("alpha"), 10)
    return a.select("alpha", kx.alias("kx"), ky.alias("ky"))


_CURVE = f"""{_TOPS}, cu AS (SELECT 'x' AS series, b AS budget, CAST(b AS DOUBLE) * 1.5 AS cost, (SELECT count(*) FROM ra WHERE rank <= {K} AND rx <= b) * 1.0 / (SELECT count(*) FROM ra WHERE rank <= {K}) AS recall
FROM (SELECT unnest([10, 20, 40, 80, 160]) AS b))"""


def _curve(spark, sf_dir):
    p, q = X.points(spark, sf_dir), X.queries(spark, sf_dir)
    truth = knn.exact_dual_knn(p, q, K, "fused", digits=DIGITS).select("qid", "id")
    x = knn.exact_dual_knn(p, q, 160, "x", digits=DIGITS).select("qid", "id", F.col("rank").alias("rx"))
    hits = truth.join(x, ["qid", "id"], "left")
    b = F.explode(F.array(*[F.lit(b) for b in (10, 20, 40, 80, 160)]))
    c = hits.withColumn("budget", b).groupBy("budget").agg((F.sum((F.col("rx") <= F.col("budget")).cast("int")) / F.count("*")).alias("recall"))
    return c.select(F.lit("x").alias("series"), "budget", (F.col("budget") * 1.5).alias("cost"), "recall")


@query(f"""WITH {_CURVE}, l AS (SELECT *, lead(recall) OVER (PARTITION BY series ORDER BY budget) AS r2, lead(cost) OVER (PARTITION BY series ORDER BY budget) AS c2 FROM cu)
SELECT series, target, round(CASE WHEN recall = target THEN cost ELSE cost + (target - recall) / (r2 - recall) * (c2 - cost) END, 6) AS cost
FROM (SELECT *, row_number() OVER (PARTITION BY series, target ORDER BY recall <> target, budget) AS k
FROM l, (SELECT CAST(unnest([0.2, 0.4, 0.6, 0.8, 0.95]) AS DOUBLE) AS target) WHERE recall = target OR (recall < target AND target < r2)) WHERE k = 1""")
def matched_recall_interp(spark, sf_dir):
    m = metrics.matched_recall(_curve(spark, sf_dir), [0.2, 0.4, 0.6, 0.8, 0.95])
    return m.select("series", "target", _r(F.col("cost")).alias("cost"))


@query(f"WITH {_CURVE} SELECT series, target, min(cost) AS cost FROM cu, (SELECT CAST(unnest([0.2, 0.4, 0.6, 0.8, 0.95]) AS DOUBLE) AS target) WHERE recall >= target GROUP BY series, target")
def work_frontier(spark, sf_dir):
    return metrics.work_frontier(_curve(spark, sf_dir), [0.2, 0.4, 0.6, 0.8, 0.95])


def _values(spark, sf_dir, of):
    """What metrics.ordered() asks for: the values of(block) of all pairs, by task."""
    return lambda emit, schema, done: _pairs(spark, sf_dir, ("x", "y"), lambda block, state: emit(of(block), state), schema, done)


@query(f"""WITH {_TOPS}, s AS (SELECT dist, row_number() OVER (ORDER BY dist) AS k, count(*) OVER () AS n FROM ra)
SELECT CAST(p AS DOUBLE) AS p, max(dist) FILTER (k <= CAST(floor(p * n) AS BIGINT) + 1) AS value FROM s, (SELECT CAST(unnest([0.5, 0.9, 0.99]) AS DOUBLE) AS p) GROUP BY p""")
def stats_percentiles(spark, sf_dir):
    def fused(block):
        d = block.alpha * np.sqrt(block.squares("x")) + (1 - block.alpha) * np.sqrt(block.squares("y"))
        return knn.half_up(d[block.known("x", "y")], DIGITS)

    shares = (0.5, 0.9, 0.99)
    at = lambda p, n: min(int(p * n), n - 1)
    got, n, *_ = metrics.ordered(_values(spark, sf_dir, fused), lambda n: {at(p, n) for p in shares})
    return spark.createDataFrame([(p, got[at(p, n)] if n else None) for p in shares], "p double, value double")


@query(f"""WITH {_TOPS}, s AS (SELECT dx / (dx + dy) AS v FROM ra) SELECT count(v) AS valid, count(*) - count(v) AS undefined, round(avg(v), 6) AS mean,
round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 FROM s""")
def distance_scale_summary(spark, sf_dir):
    def share(block):
        known = block.known("x", "y")
        dx, dy = (knn.half_up(np.sqrt(block.squares(c))[known], DIGITS) for c in "xy")
        undefined = np.full(block.other.sum() - known.sum(), np.nan)
        return np.concatenate((np.where(dx + dy > 0, dx / (dx + dy), np.nan), undefined))

    shares = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    ends = lambda p, n: (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))
    got, n, undefined, total = metrics.ordered(_values(spark, sf_dir, share), lambda n: {r for p in shares.values() for r in ends(p, n)})
    row = {"mean": total / n if n else None}
    for name, p in shares.items():
        a, b = (got[r] for r in ends(p, n)) if n else (None, None)
        row[name] = a + (b - a) * (p * (n - 1) - ends(p, n)[0]) if n else None
    s = spark.createDataFrame([(n, undefined, *(row[c] for c in ("mean", "p10", "median", "p90")))], "valid long, undefined long, mean double, p10 double, median double, p90 double")
    return s.select("valid", "undefined", *[_r(F.col(c)).alias(c) for c in ("mean", "p10", "median", "p90")])


# Layout


@query("SELECT id, CAST(i // 12 AS BIGINT) AS page_id, CAST(i % 12 AS BIGINT) AS slot FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings)")
def page_layout(spark, sf_dir):
    return layout.assign_pages(X.points(spark, sf_dir), 12)


@query(f"""WITH {_TOPS}, pg AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 12 AS page FROM v)
SELECT qid, count(DISTINCT page) AS pages, count(*) AS nodes FROM ra JOIN pg USING (id) WHERE rank <= 40 GROUP BY qid""")
def page_counts(spark, sf_dir):
    top = knn.exact_dual_knn(X.points(spark, sf_dir), X.queries(spark, sf_dir), 40, "fused", digits=DIGITS)
    return layout.page_reads(top, layout.assign_pages(X.points(spark, sf_dir), 12))


@query("SELECT CAST(slots AS BIGINT) AS slots, CAST(4 + 40 * (4 + 2 * slots) AS BIGINT) AS bytes, CAST(8192 // (4 + 40 * (4 + 2 * slots)) AS BIGINT) AS per_page FROM (SELECT unnest([0, 2, 6, 7]) AS slots)")
def record_sizes(spark, sf_dir):
    return spark.createDataFrame([(s, b := layout.topology_bytes(40, s), layout.records_per_page(b)) for s in (0, 2, 6, 7)], "slots long, bytes long, per_page long")


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM (SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 <> 3)")
def id_remap(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return layout.remap_ids(p, p.where("id % 7 = 3"))


@query("SELECT 0 AS missing, 0 AS twice, 0 AS strange, 0 AS beyond")
def layout_violations(spark, sf_dir):
    p = X.points(spark, sf_dir)
    return layout.violations(layout.assign_pages(p, 12), p, 12).select(*[F.col(c).cast("int").alias(c) for c in ("missing", "twice", "strange", "beyond")])


# Quantisation

CHUNKS, CODES = 8, 64
_PQ = f"""{X.SQL}, b AS (SELECT row_number() OVER (ORDER BY id) - 1 AS code, x, y FROM (SELECT * FROM v ORDER BY id LIMIT {CODES})),
ch AS (SELECT unnest(range(0, {CHUNKS})) AS c),
en AS (SELECT v.id, ch.c, b.code, list_sum(list_transform(range(1, 5), lambda i: (v.x[ch.c * 4 + i] - b.x[ch.c * 4 + i]) * (v.x[ch.c * 4 + i] - b.x[ch.c * 4 + i]))) AS ex,
  list_sum(list_transform(range(1, 5), lambda i: (v.y[ch.c * 4 + i] - b.y[ch.c * 4 + i]) * (v.y[ch.c * 4 + i] - b.y[ch.c * 4 + i]))) AS ey FROM v, ch, b),
cx AS (SELECT id, c, arg_min(code, round(ex, 12) * 1000000 + code * 0.0000001) AS code FROM en GROUP BY id, c), cy AS (SELECT id, c, arg_min(code, round(ey, 12) * 1000000 + code * 0.0000001) AS code FROM en GROUP BY id, c)"""
_ADC = f"""{_PQ}, ad AS (SELECT e.qid, x.id, e.alpha, sum(t.ex) AS ax, sum(t2.ey) AS ay FROM q e JOIN cx x ON x.id <> e.qid JOIN en t ON t.id = e.qid AND t.c = x.c AND t.code = x.code
JOIN cy y ON y.id = x.id AND y.c = x.c JOIN en t2 ON t2.id = e.qid AND t2.c = y.c AND t2.code = y.code GROUP BY e.qid, x.id, e.alpha),
ar AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT qid, id, round(alpha * sqrt(ax) + (1 - alpha) * sqrt(ay), 6) AS dist FROM ad))"""


def _coded(spark, sf_dir, space: str):
    p = X.points(spark, sf_dir).select("id", F.col(space).alias("vec"))
    book = pq.fixed_codebook(p, CHUNKS, X.HALF, CODES)
    return pq.encode(p, book), book


@query(f"WITH {_PQ} SELECT id, CAST(c AS BIGINT) AS chunk, CAST(code AS BIGINT) AS code FROM cx")
def pq_encode_fixed(spark, sf_dir):
    c, _ = _coded(spark, sf_dir, "x")
    return c.select("id", F.posexplode("codes").alias("chunk", "code")).select("id", F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"))


def _adc(spark, sf_dir, k: int) -> DataFrame:
    (cx, bx), (cy, by) = (_coded(spark, sf_dir, s) for s in "xy")
    return pq.adc_search(cx, X.queries(spark, sf_dir), bx, k, cy, by, digits=DIGITS)


@query(f"WITH {_ADC} SELECT qid, rank, id, dist FROM ar WHERE rank <= {K}")
def adc_topk_fixed(spark, sf_dir):
    return _adc(spark, sf_dir, K)


@query(f"""WITH {_ADC} SELECT qid, rank, id, dist FROM (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank
FROM (SELECT d.qid, d.id, round({_FUSED}, 6) AS dist FROM d JOIN ar ON ar.qid = d.qid AND ar.id = d.id WHERE ar.rank <= 40)) WHERE rank <= {K}""")
def pq_rerank(spark, sf_dir):
    return knn.rerank(_adc(spark, sf_dir, 40).select("qid", "id"), X.points(spark, sf_dir), X.queries(spark, sf_dir), K, DIGITS)


@query()
def pq_kmeans(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    book = pq.train(p, CHUNKS, X.HALF, CODES)
    return pq.adc_search(pq.encode(p, book), X.queries(spark, sf_dir), book, K, digits=DIGITS)


@query()
def pq_refined(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    return pq.refine(p, pq.fixed_codebook(p, CHUNKS, X.HALF, CODES))


@query(f"""WITH {_PQ}, pr AS (SELECT id AS a, (id + 1) % (SELECT count(*) FROM v) AS b FROM v)
SELECT a, b, round(sum(list_sum(list_transform(range(1, 5), lambda i: (p.x[s.c * 4 + i] - r.x[s.c * 4 + i]) * (p.x[s.c * 4 + i] - r.x[s.c * 4 + i])))), 6) AS d2
FROM pr JOIN cx s ON s.id = a JOIN cx t ON t.id = b AND t.c = s.c JOIN b p ON p.code = s.code JOIN b r ON r.code = t.code GROUP BY a, b""")
def code_distances(spark, sf_dir):
    c, book = _coded(spark, sf_dir, "x")
    n = c.count()
    return pq.code_distance(c, c.select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b")), book).select("a", "b", _r(F.col("d2")).alias("d2"))


@query(f"""WITH {X.SQL}, b AS (SELECT id AS code, x FROM v WHERE id < {2 * CODES}), ch AS (SELECT unnest(range(0, {CHUNKS})) AS c),
en AS (SELECT v.id, ch.c, b.code, list_sum(list_transform(range(1, 5), lambda i: (v.x[ch.c * 4 + i] - b.x[ch.c * 4 + i]) * (v.x[ch.c * 4 + i] - b.x[ch.c * 4 + i]))) AS ex FROM v, ch, b)
SELECT id, CAST(c AS BIGINT) AS chunk, CAST(code AS BIGINT) AS code, CAST(code >= {CODES} AS INTEGER) AS branch
FROM (SELECT *, row_number() OVER (PARTITION BY id, c ORDER BY round(ex, 12), code) AS r FROM en) WHERE r = 1""")
def pq_two_codebooks(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    one, two = (pq.fixed_codebook(part, CHUNKS, X.HALF, CODES) for part in (p, p.where(f"id >= {CODES}")))
    return pq.branches(pq.encode(p, pq.joined(one, two)), CODES)


# Shards


@query(f"""WITH {X.SQL}, ce AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x AS cv FROM (SELECT * FROM v ORDER BY id LIMIT 8))
SELECT id, rank, cid, d2 FROM (SELECT id, cid, d2, row_number() OVER (PARTITION BY id ORDER BY d2, cid) AS rank FROM (SELECT id, cid, round({X.sql_sq("x", "cv")}, 6) AS d2 FROM v, ce)) WHERE rank <= 2""")
def shard_assign_k2(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    return knn.assign_centers(p, shard.first_centers(p, 8), 2).withColumn("d2", _r(F.col("d2")))


@query(f"""WITH {X.SQL}, ce AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x AS cv FROM (SELECT * FROM v ORDER BY id LIMIT 8))
SELECT cid, count(*) AS n FROM (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY round({X.sql_sq("x", "cv")}, 12), cid) AS rank FROM v, ce) WHERE rank = 1 GROUP BY cid""")
def cluster_sizes(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    return shard.cluster_sizes(p, shard.first_centers(p, 8))


@query()
def shard_by_budget(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    return shard.partition_with_budget(p, 200, copies=2)


@query("SELECT vec_id AS id, label FROM embeddings WHERE CAST('0x' || substr(md5('42:' || vec_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2")
def sample_bernoulli(spark, sf_dir):
    return shard.random_slice(X.points(spark, sf_dir).select("id", "label"), 0.2, 42)


# Graph building, search and updates


def _dual(spark, sf_dir):
    return graph.build_dual(X.points(spark, sf_dir).select("id", "x", "y"), degree=16, pool=40)


#: Graphs that searches share: (application, folder) -> a written table, which lives as long as the application.
_shared_graphs: dict[tuple[str, str], DataFrame] = {}


def _shared_dual(spark, sf_dir) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shared_graphs:
        _shared_graphs[key] = written(_dual(spark, sf_dir), "shared-graph")
    return _shared_graphs[key]


@query()
def graph_build(spark, sf_dir):
    return _dual(spark, sf_dir).select("src", "pos", "dst", "layer", F.size("ranges").alias("slots"), _r(R.width(F.col("ranges"))).alias("width"))


@query()
def graph_build_single(spark, sf_dir):
    return graph.build_single(X.points(spark, sf_dir).select("id", F.col("x").alias("vec")), degree=16, pool=40)


@query()
def graph_fixed_alpha(spark, sf_dir):
    return graph.build_fixed(X.points(spark, sf_dir).select("id", "x", "y"), alpha=0.5, degree=16, pool=40)


@query()
def graph_merge(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", "x", "y")
    return shard.build_sharded(p, max_rows=200, degree=16, pool=40).select("src", "pos", "dst", "layer")


@query()
def topology_compact(spark, sf_dir):
    return graph.with_ranges(_shared_dual(spark, sf_dir), "merge").select("src", "pos", "dst", F.size("ranges").alias("slots"))


def _search(spark, sf_dir, mode: str, **options):
    p = X.points(spark, sf_dir).select("id", "x", "y")
    return search.search(p, _shared_dual(spark, sf_dir), X.queries(spark, sf_dir), k=K, pool=64, mode=mode, **options).withColumn("dist", _r(F.col("dist")))


@query()
def search_beam(spark, sf_dir):
    return _search(spark, sf_dir, "beam")


@query()
def search_page(spark, sf_dir):
    return _search(spark, sf_dir, "page")


@query()
def search_rerank(spark, sf_dir):
    return _search(spark, sf_dir, "rerank")


@query()
def search_dap(spark, sf_dir):
    return _search(spark, sf_dir, "dap")


@query()
def search_frames(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", "x", "y")
    return search.search_frames(p, _shared_dual(spark, sf_dir), X.queries(spark, sf_dir), k=K, pool=40).withColumn("dist", _r(F.col("dist")))


@query()
def search_multigraph(spark, sf_dir):
    return search.search_multigraph(X.points(spark, sf_dir).select("id", "x", "y"), X.queries(spark, sf_dir), k=K, budget=20).withColumn("dist", _r(F.col("dist")))


@query()
def visit_frequency(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", "x", "y")
    return metrics.visit_counts(search.trace(p, _shared_dual(spark, sf_dir), X.queries(spark, sf_dir), pool=40))


@query(f"""WITH ev AS (SELECT event_id % (SELECT count(*) FROM embeddings) AS tag, event_id AS seq, event_type IN ('click', 'view') OR event_id % 3 = 0 AS dead FROM events),
la AS (SELECT tag, arg_max(dead, seq) AS dead, max(seq) AS seq FROM ev GROUP BY tag)
SELECT vec_id AS tag, coalesce(seq, -1) AS seq FROM embeddings LEFT JOIN la ON tag = vec_id WHERE NOT coalesce(dead, false)""")
def dynamic_replay(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = X.points(spark, sf_dir)
    n = p.count()
    dead = F.col("event_type").isin("click", "view") | (F.col("event_id") % 3 == 0)
    ops = ev.select((F.col("event_id") % n).alias("tag"), F.col("event_id").alias("seq"), F.when(dead, "delete").otherwise("insert").alias("op"))
    return dynamic.apply_ops(p.select(F.col("id").alias("tag"), F.lit(-1).cast("long").alias("seq")), ops)


# Element types, norms, lists of ids


@query(f"""WITH {X.SQL}, h AS (SELECT id, i AS pos, e[i] * 1000 AS t, greatest(floor(log2(abs(e[i] * 1000))), -14) AS p FROM v, range(1, 65) t(i)),
b AS (SELECT id, pos, t, CASE WHEN t = 0 THEN 0 ELSE CAST((p + 14) * 1024 + round_even(abs(t) * pow(2.0, 10 - p), 0) AS INTEGER) END AS size FROM h),
w AS (SELECT id, pos, size + CASE WHEN t < 0 THEN 32768 ELSE 0 END AS bits, CASE WHEN t < 0 THEN -1.0 ELSE 1.0 END AS sign, size >> 10 AS e, size & 1023 AS m FROM b)
SELECT id, CAST(pos AS BIGINT) AS pos, CAST(bits AS INTEGER) AS bits, CAST(sign * CASE WHEN e = 0 THEN m * pow(2.0, -24) ELSE (m + 1024) * pow(2.0, e - 25) END + 0.0 AS DOUBLE) AS value FROM w""")
def half_precision(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.posexplode("e").alias("pos", "t")).withColumn("bits", V.fp16_bits(F.col("t") * 1000))
    return p.select("id", (F.col("pos") + 1).cast("long").alias("pos"), "bits", (V.fp16_value(F.col("bits")) + 0.0).alias("value"))


@query(f"WITH {X.SQL} SELECT id, CAST(i AS BIGINT) AS pos, CAST(trunc(e[i] * 100) AS INTEGER) AS value FROM v, range(1, 65) t(i)")
def converted_types(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.posexplode(V.convert(F.transform("e", lambda t: t * 100), "int8")).alias("pos", "value"))
    return p.select("id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("value").cast("int").alias("value"))


@query(f"""WITH {X.SQL}, u AS (SELECT id, list_transform(e, lambda t: t / sqrt(list_sum(list_transform(e, lambda u: u * u)))) AS u FROM v)
SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank
FROM (SELECT a.id AS qid, b.id, round(sqrt({X.sql_sq("a.u", "b.u", 64)}), 6) AS dist FROM u a, u b WHERE a.id % {X.EVERY} = 0 AND a.id <> b.id)) WHERE rank <= {K}""")
def normalised_topk(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", V.l2_normalize(F.col("e")).alias("vec"))
    q = X.queries(spark, sf_dir).select("qid", V.l2_normalize(F.col("e")).alias("vec"))
    return knn.exact_knn(p, q, K, digits=DIGITS).select("qid", "rank", "id", "dist")


@query(f"""WITH {X.SQL} SELECT qid, v.id, round(list_cosine_similarity(qe, e), 6) + 0.0 AS similarity FROM q, range(1, 9) t(j), (SELECT count(*) AS n FROM v) JOIN v ON true WHERE v.id = (qid + j * 7) % n""")
def cosine_of_lists(spark, sf_dir):
    p, q = X.points(spark, sf_dir), X.queries(spark, sf_dir)
    n = p.count()
    lists = q.select("qid", F.col("e").alias("qe"), F.explode(F.array(*[(F.col("qid") + j * 7) % n for j in range(1, 9)])).alias("id"))
    return lists.join(p, "id").select("qid", "id", _r(V.cosine_similarity(F.col("qe"), F.col("e"))).alias("similarity"))


@query(f"""WITH {X.SQL}, ce AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, x AS cv FROM (SELECT * FROM v ORDER BY id LIMIT 8)),
a AS (SELECT id, x, cid, cv, row_number() OVER (PARTITION BY id ORDER BY round({X.sql_sq("x", "cv")}, 12), cid) AS rank FROM v, ce)
SELECT id, cid, CAST(i AS BIGINT) AS pos, round(x[i] - cv[i], 6) + 0.0 AS value FROM a, range(1, 33) t(i) WHERE rank = 1""")
def residuals(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    c = shard.first_centers(p, 8)
    near = knn.assign_centers(p, c, 1).select("id", "cid").join(F.broadcast(c.select("cid", F.col("vec").alias("centre"))), "cid").join(p, "id")
    r = near.select("id", "cid", F.posexplode(V.residual(F.col("vec"), F.col("centre"))).alias("pos", "value"))
    return r.select("id", "cid", (F.col("pos") + 1).cast("long").alias("pos"), _r(F.col("value")).alias("value"))


# Stored indexes: layouts, sidecars, tags


#: Four edges a node at fixed steps, with the ranges of the node that they lead to.
_RING = f"""{X.SQL}, rg AS (SELECT id AS src, CAST(j AS BIGINT) AS pos, (id + j * j * 7) % n AS dst FROM v, range(1, 5) t(j), (SELECT count(*) AS n FROM v)), {X.SQL_INTERVALS}"""


def _ring(spark, sf_dir) -> DataFrame:
    p = X.points(spark, sf_dir).select("id")
    n = p.count()
    e = p.select(F.col("id").alias("src"), F.explode(F.array(*[F.lit(j).cast("long") for j in range(1, 5)])).alias("pos"))
    e = e.withColumn("dst", (F.col("src") + F.col("pos") * F.col("pos") * 7) % n)
    r = X.intervals(spark, sf_dir).withColumnRenamed("id", "dst")
    return e.join(r, "dst", "left").withColumn("ranges", F.coalesce("ranges", R.none())).select("src", "pos", "dst", "ranges")


@query(f"""WITH {_RING} SELECT src, pos, dst, (src + pos) % 3 = 0 OR EXISTS (SELECT 1 FROM iv WHERE iv.id = dst AND round(lo * 100) <= src % 11 * 10 AND src % 11 * 10 <= round(hi * 100)) AS active FROM rg""")
def sidecar_filter(spark, sf_dir):
    e = _ring(spark, sf_dir)
    rows = store.sidecar(e.where("(src + pos) % 3 <> 0"))
    got = e.select("src", "pos", "dst").join(rows, ["src", "pos"], "left")
    return got.select("src", "pos", "dst", store.sidecar_active(F.col("ranges"), (F.col("src") % 11) / 10.0).alias("active"))


@query(f"""WITH {_RING}, f AS (SELECT src, pos, dst, (SELECT count(*) FROM iv WHERE iv.id = dst) AS slots, (SELECT coalesce(round(sum(hi - lo), 6), 0.0) FROM iv WHERE iv.id = dst) AS width FROM rg)
SELECT src, pos, dst, CAST(slots AS INTEGER) AS slots, CAST(width AS DOUBLE) AS width, round(x[1], 6) + 0.0 AS x1, round(y[1], 6) + 0.0 AS y1, src * 10 + 3 AS tag FROM f JOIN v ON src = v.id""")
def stored_index(spark, sf_dir):
    """Saved in one table, copied, split into three, read back."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    p = X.points(spark, sf_dir).select("id", "x", "y")
    store.save(f"{folder}/one", p, _ring(spark, sf_dir), p.select("id", (F.col("id") * 10 + 3).alias("tag")), "TXY", degree=4, slots=5, pages=8)
    store.copy(spark, f"{folder}/one", f"{folder}/copy")
    store.split(spark, f"{folder}/copy", f"{folder}/three", "T_X_Y")
    s = store.load(spark, f"{folder}/three")
    e = s.edges.join(s.points.withColumnRenamed("id", "src"), "src").join(s.tags.withColumnRenamed("id", "src"), "src")
    width = F.aggregate("ranges", F.lit(0.0), lambda a, r: a + (r.hi - r.lo))
    return e.select("src", "pos", "dst", F.size("ranges").alias("slots"), _r(width).alias("width"), _r(F.get("x", 0)).alias("x1"), _r(F.get("y", 0)).alias("y1"), "tag")


@query("SELECT vec_id * 10 + 3 AS tag, vec_id AS id, label, vec_id % 7 <> 3 AS alive FROM embeddings WHERE vec_id % 20 = 0")
def tag_lookup(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", "label")
    tags = p.select("id", (F.col("id") * 10 + 3).alias("tag"))
    asked = X.queries(spark, sf_dir).select((F.col("qid") * 10 + 3).alias("tag"))
    alive = store.active_tags(tags, tags.where("id % 7 = 3")).withColumn("alive", F.lit(True))
    return store.by_tag(p, tags, asked).join(alive, "tag", "left").select("tag", "id", "label", F.coalesce("alive", F.lit(False)).alias("alive"))


@query(f"WITH {_RING} SELECT src * 10 + 3 AS src, pos, dst * 10 + 3 AS dst FROM rg")
def shard_to_global(spark, sf_dir):
    e = _ring(spark, sf_dir)
    return store.to_global(e, X.points(spark, sf_dir).select(F.col("id").alias("local"), (F.col("id") * 10 + 3).alias("id")))


@query("SELECT vec_id AS id, (n - 1 - vec_id) // 12 AS page_id, (n - 1 - vec_id) % 12 AS slot FROM embeddings, (SELECT count(*) AS n FROM embeddings)")
def page_reorder(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id")
    n = p.count()
    return store.reorder(p, p.select("id", (n - 1 - F.col("id")).alias("at")), 12)


def _reads() -> str:
    parts = []
    for kind, groups in store.LAYOUTS.items():
        for g in groups:
            size = store.group_bytes(g, 768, 768, 54, 5)
            per, each = max(1, layout.PAGE // size), -(-size // layout.PAGE)
            wanted = "(" + ", ".join(f"'{c}'" for c in g) + ")"
            parts.append(f"SELECT DISTINCT '{kind}' AS layout, '{g}' AS g, qid, id // {per} AS p, {each} AS each FROM h WHERE part IN {wanted}")
    return f"""WITH {_TOPS}, h AS (SELECT qid, id, 'T' AS part FROM ra WHERE rank <= 40 UNION ALL SELECT qid, id, 'X' FROM ra WHERE rank <= {K} UNION ALL SELECT qid, id, 'Y' FROM ra WHERE rank <= {K})
SELECT layout, qid, CAST(sum(each) AS BIGINT) AS pages FROM ({" UNION ALL ".join(parts)}) GROUP BY layout, qid"""


@query(_reads())
def layout_reads(spark, sf_dir):
    """Pages that each layout reads for 40 expanded and 10 scored nodes a query, at 768 + 768 dimensions."""
    top = knn.exact_dual_knn(X.points(spark, sf_dir), X.queries(spark, sf_dir), 40, "fused", digits=DIGITS)
    parts = [top.select("qid", F.col("id").alias("at"), F.lit("T").alias("part"))]
    parts += [top.where(F.col("rank") <= K).select("qid", F.col("id").alias("at"), F.lit(c).alias("part")) for c in "XY"]
    hits = written(parts[0].union(parts[1]).union(parts[2]), "hits")
    out = [store.page_reads(hits, kind, 768, 768, 54, 5).select(F.lit(kind).alias("layout"), "qid", "pages") for kind in store.LAYOUTS]
    for o in out[1:]:
        out[0] = out[0].union(o)
    return out[0]


@query("SELECT 0 AS loops, 0 AS repeats, 0 AS unknown, 0 AS gaps, 0 AS beyond")
def edge_soundness(spark, sf_dir):
    p = X.points(spark, sf_dir)
    v = store.edge_violations(_graph(spark, sf_dir), p, K)
    return v.select(*[F.col(c).cast("int").alias(c) for c in v.columns])


@query("SELECT 0 AS wrong, 0 AS unsorted, 0 AS after_end, 0 AS narrowed")
def range_soundness(spark, sf_dir):
    third = F.transform(R.union(F.col("ranges")), lambda r: R.span(r.lo * 0.3337, r.hi * 0.3337))
    e = X.intervals(spark, sf_dir).select(third.alias("ranges")).withColumn("slots", R.quantize(F.col("ranges")))
    v = store.range_violations(e)
    return v.select(*[F.col(c).cast("int").alias(c) for c in v.columns])


# Statistics of runs, ranges and traces


@query("""WITH s AS (SELECT event_type AS run, round(abs(value), 3) + 1 AS us FROM events), o AS (SELECT run, us, row_number() OVER (PARTITION BY run ORDER BY us) AS k, count(*) OVER (PARTITION BY run) AS n FROM s WHERE us IS NOT NULL)
SELECT run, count(*) AS queries, round(count(*) * 4e6 / sum(us), 3) AS qps, round(avg(us), 6) AS mean, min(us) FILTER (k > floor(0.5 * n)) AS p50, min(us) FILTER (k > floor(0.999 * n)) AS p99_9 FROM o GROUP BY run""")
def latency_by_run(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("run"), (F.round(F.abs("value"), 3) + 1).alias("us"))
    s = metrics.latency_summary(e, "run", "us", shares=(0.5, 0.999), threads=4)
    return s.select("run", "queries", F.round("qps", 3).alias("qps"), F.round("mean", 6).alias("mean"), "p50", "p99_9")


@query(f"""WITH {X.SQL_INTERVALS}, h AS (SELECT CAST(vec_id % 11 AS INTEGER) * 10 AS percent, count(*) AS n FROM embeddings WHERE vec_id % 20 = 0 GROUP BY 1),
s AS (SELECT id, slot, CAST(round(lo * 100) AS INTEGER) AS lo, CAST(round(hi * 100) AS INTEGER) AS hi, row_number() OVER (PARTITION BY id ORDER BY lo, hi, slot) AS i FROM iv),
p AS (SELECT a.id, count(*) AS pairs FROM s a JOIN s b ON a.id = b.id AND a.i < b.i AND b.lo <= a.hi GROUP BY a.id),
w AS (SELECT id, sum(n) AS served FROM (SELECT DISTINCT id, percent, n FROM s JOIN h ON percent BETWEEN lo AND hi) GROUP BY id), e AS (SELECT DISTINCT id FROM s)
SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM s) AS slots, (SELECT round(avg(hi - lo), 6) FROM s) AS mean_width, (SELECT CAST(sum(pairs) AS BIGINT) FROM p) AS overlaps,
(SELECT count(*) FROM p) AS overlapping, round((SELECT sum(served) FROM w) / (SELECT count(*) FROM e), 6) AS mean_served""")
def interval_statistics(spark, sf_dir):
    e = X.intervals(spark, sf_dir).select(F.col("id").alias("key"), R.quantize(F.col("ranges")).alias("slots"))
    h = X.queries(spark, sf_dir).groupBy((F.col("qid") % 11 * 10).alias("percent")).agg(F.count("*").alias("n"))
    s = metrics.interval_statistics(e, h)
    return s.select("edges", "slots", F.round("mean_width", 6).alias("mean_width"), "overlaps", "overlapping", F.round("mean_served", 6).alias("mean_served"))


@query(f"""WITH {_KNN}, {X.SQL_INTERVALS}, n AS (SELECT count(*) AS n FROM v), x AS (SELECT qid, alpha, CAST(s AS BIGINT) AS step, (qid * 3 + s * 11) % n AS src FROM q, range(0, 12) t(s), n),
e AS (SELECT qid, step, pos, dst AS id, NOT (dst % 6 = 0 OR EXISTS (SELECT 1 FROM iv WHERE iv.id = dst AND round(lo * 100) <= round(alpha * 100) AND round(alpha * 100) <= round(hi * 100))) AS blocked FROM x JOIN kg USING (src)),
f AS (SELECT qid, id, arg_min(blocked, step * 1000 + pos) AS blocked FROM e WHERE id >= 3 GROUP BY qid, id),
g AS (SELECT qid, count(*) AS scanned, count(*) FILTER (blocked) AS inactive FROM e GROUP BY qid),
t AS (SELECT src AS qid, dst AS id, true AS hit FROM kg)
SELECT g.qid, scanned, inactive, count(f.id) AS found, count(*) FILTER (blocked) AS found_inactive, count(*) FILTER (blocked AND hit) AS hits_inactive
FROM g LEFT JOIN f ON g.qid = f.qid LEFT JOIN t ON t.qid = f.qid AND t.id = f.id GROUP BY g.qid, scanned, inactive""")
def discovery_audit(spark, sf_dir):
    g, p, q = written(_graph(spark, sf_dir), "graph"), X.points(spark, sf_dir), X.queries(spark, sf_dir)
    n = p.count()
    x = q.select("qid", F.explode(F.array(*[F.lit(s).cast("long") for s in range(12)])).alias("step")).withColumn("src", (F.col("qid") * 3 + F.col("step") * 11) % n)
    slots = X.intervals(spark, sf_dir).select(F.col("id").alias("dst"), R.quantize(F.col("ranges")).alias("slots"))
    e = g.join(slots, "dst", "left").withColumn("slots", F.coalesce("slots", F.array().cast(store.HUNDREDTHS)))
    return metrics.first_discoveries(x, e, q.select("qid", "alpha"), p.where("id < 3").select("id"), g.select(F.col("src").alias("qid"), F.col("dst").alias("id")))


@query("""SELECT m AS method, CAST(a AS DOUBLE) / 20 AS alpha, CAST(CASE WHEN m = 'endpoint' AND a <= 1 THEN 0 WHEN m = 'endpoint' AND a >= 19 THEN 20 ELSE 10 END AS BIGINT) AS kx,
CAST(CASE WHEN m = 'endpoint' AND a <= 1 THEN 20 WHEN m = 'endpoint' AND a >= 19 THEN 0 ELSE 10 END AS BIGINT) AS ky FROM range(0, 21) t(a), (SELECT unnest(['equal', 'endpoint']) AS m)""")
def candidate_budgets(spark, sf_dir):
    a = spark.range(21).select((F.col("id") / 20.0).alias("alpha"))
    parts = []
    for m in ("equal", "endpoint"):
        kx, ky = metrics.candidate_budget(m, F.col("alpha"), 10)
        parts.append(a.select(F.lit(m).alias("method"), "alpha", kx.alias("kx"), ky.alias("ky")))
    return parts[0].union(parts[1])


@query("""SELECT CAST(a AS DOUBLE) / 100 AS alpha, CAST(arg_min(i, round(abs(a / 100.0 - (2 * i + 1) / 10.0), 6) * 1000 + i * 0.0001) AS INTEGER) AS route FROM range(0, 101) t(a), range(0, 5) u(i) GROUP BY a""")
def routes(spark, sf_dir):
    a = spark.range(101).select((F.col("id") / 100.0).alias("alpha"))
    return a.select("alpha", metrics.nearest_weight(F.col("alpha"), search.SPECIALISED).alias("route"))


# Updates


_MERGED = f"""{_KNN}, nw AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM v WHERE id % 7 <> 3),
li AS (SELECT src AS via, dst, row_number() OVER (PARTITION BY src ORDER BY pos) AS r FROM kg WHERE src % 7 = 3 AND dst % 7 <> 3),
sp AS (SELECT src, dst FROM kg WHERE src % 7 <> 3 AND dst % 7 <> 3 UNION SELECT k.src, li.dst FROM kg k JOIN li ON k.dst = via WHERE k.src % 7 <> 3 AND r <= 3),
pl AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round({X.sql_sq("a.x", "b.x")}, 9), dst) AS pos FROM sp JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE src <> dst)"""


@query(f"WITH {_MERGED} SELECT a.new_id AS src, pos, b.new_id AS dst FROM pl JOIN nw a ON a.id = src JOIN nw b ON b.id = dst")
def deletions_merged(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    return updates.merge_deletes(written(_graph(spark, sf_dir), "graph"), p.where("id % 7 = 3").select("id"), 64, p, sampled=3)[0]


@query(f"WITH {_MERGED} SELECT src, pos, dst FROM pl")
def deletions_in_place(spark, sf_dir):
    p = X.points(spark, sf_dir).select("id", F.col("x").alias("vec"))
    return updates.delete_in_place(written(_graph(spark, sf_dir), "graph"), p.where("id % 7 = 3").select("id"), 64, p, sampled=3)


@query("""SELECT CAST(s * 20 + CASE WHEN o = 'delete' THEN 0 ELSE 10 END + i AS BIGINT) AS seq, o AS op, CAST(CASE WHEN o = 'delete' THEN 0 ELSE 100 END + s * 10 + i AS BIGINT) AS tag
FROM range(0, 5) t(s), range(0, 10) u(i), (SELECT unnest(['delete', 'insert']) AS o)""")
def sliding_window(spark, sf_dir):
    return updates.sliding_window(spark, 0, 100, 10, 5)


# Recall against the exact answer


def _recall_of_90(name: str, got: DataFrame, truth: DataFrame) -> DataFrame:
    r = metrics.recall_at_k(got, truth, K).agg((F.avg("recall") >= 90).alias("recall_of_90"))
    return r.select(F.lit(name).alias("way"), "recall_of_90")


_WAYS = ("beam", "page", "rerank", "dap", "adaptive", "batched", "seeded", "joins", "specialised")


@query(f"SELECT unnest({list(_WAYS)}) AS way, TRUE AS recall_of_90")
def search_recall(spark, sf_dir):
    """Every way to search one graph reaches nine tenths of the exact answer."""
    p, q = X.points(spark, sf_dir).select("id", "x", "y"), X.queries(spark, sf_dir).select("qid", "x", "y", "alpha")
    e, truth = _shared_dual(spark, sf_dir), written(knn.exact_dual_knn(p, q, K).select("qid", "rank", "id", "dist"), "truth")
    found = {mode: search.search(p, e, q, K, 64, mode) for mode in search.MODES}
    found["seeded"] = search.search(p, e, q, K, 64, seeds=search.sampled_entries(p, q, 0.1))
    found["joins"] = search.search_frames(p, e, q, K, 64)
    found["specialised"] = search.search_specialised(p, q, K, pool=64)
    out = [_recall_of_90(way, found[way], truth) for way in _WAYS]
    for o in out[1:]:
        out[0] = out[0].union(o)
    return out[0]


@query("SELECT 'grown' AS way, TRUE AS recall_of_90, 0 AS loops, 0 AS repeats, 0 AS unknown, 0 AS gaps")
def graph_grown(spark, sf_dir):
    """A graph built by inserting rows that search it, a tenth of them compared exactly at first."""
    p, q = X.points(spark, sf_dir).select("id", "x", "y"), X.queries(spark, sf_dir).select("qid", "x", "y", "alpha")
    e = written(updates.build_by_search(p, 16, 40, first=max(100, p.count() // 10)), "grown")
    truth = knn.exact_dual_knn(p, q, K).select("qid", "rank", "id", "dist")
    v = store.edge_violations(e, p, 16)
    return _recall_of_90("grown", search.search(p, e, q, K, 64), truth).crossJoin(v.select(*[F.col(c).cast("int").alias(c) for c in ("loops", "repeats", "unknown", "gaps")]))


# The public index


@query(f"WITH {X.SQL} SELECT (SELECT count(*) FROM v WHERE id % 7 <> 3) AS alive, (SELECT count(*) FROM q) * {K} AS results, 0 AS removed_found, TRUE AS recall_of_90")
def index_lifecycle(spark, sf_dir):
    """Build on some rows, insert the others, remove a seventh, compact, search."""
    from twinvec.index import TwinIndex

    p = X.points(spark, sf_dir).select(F.col("id").alias("tag"), "x", "y")
    q = X.queries(spark, sf_dir).select("qid", "x", "y", "alpha")
    ix = TwinIndex.build(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", p.where("tag % 5 <> 1"))
    ix.insert(p.where("tag % 5 = 1"))
    ix.remove(p.where("tag % 7 = 3").select("tag"))
    ix.compact()
    got = written(ix.search(q, K, 64), "got")
    recall = metrics.recall_at_k(got, ix.exact(q, K), K).agg((F.avg("recall") >= 90).alias("recall_of_90"))
    n = got.agg(F.count("*").alias("results"), F.coalesce(F.sum((F.col("id") % 7 == 3).cast("int")), F.lit(0)).cast("int").alias("removed_found"))
    return ix.points().agg(F.count("*").alias("alive")).crossJoin(n).crossJoin(recall)

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinvec.functions import intervals as R
from twinvec.functions import registry
from twinvec.functions import vector as V
from twinvec.operators.graph import _solve, _subtract


def ranges(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id long, r {R.TYPE}")


def run(spark, rows, f):
    got = ranges(spark, rows).select("id", f(F.col("r")).alias("r")).orderBy("id").collect()
    return [[(round(x.lo, 9), round(x.hi, 9)) for x in row.r] for row in got]


def test_union_cases(spark):
    rows = [[], [(0.0, 1.0)], [(0.1, 0.2), (0.7, 0.9)], [(0.1, 0.4), (0.2, 0.8)], [(0.1, 0.8), (0.2, 0.3)], [(0.0, 0.5), (0.5, 1.0)], [(0.8, 1.0), (0.1, 0.3), (0.2, 0.9)]]
    assert run(spark, rows, R.union) == [[], [(0.0, 1.0)], [(0.1, 0.2), (0.7, 0.9)], [(0.1, 0.8)], [(0.1, 0.8)], [(0.0, 1.0)], [(0.1, 1.0)]]


def test_complement_case(spark):
    assert run(spark, [[(0.1, 0.2), (0.7, 0.9)]], R.complement) == [[(0.0, 0.1), (0.2, 0.7), (0.9, 1.0)]]


def test_half_plane_cases(spark):
    cases = [(0, 2), (0, 0), (0, -1), (2, 0), (-2, 0), (-2, -2)]
    df = spark.createDataFrame([(i, float(s), float(r)) for i, (s, r) in enumerate(cases)], "id long, s double, r double")
    got = [None if x.h is None else (x.h.lo + 0.0, x.h.hi + 0.0) for x in df.select("id", R.half_plane(F.col("s"), F.col("r")).alias("h")).orderBy("id").collect()]
    assert got == [(0, 1), (0, 1), None, (0, 0), (0, 1), (1, 1)]


def test_compress_covers_and_keeps_widest_gap(spark):
    rng = np.random.default_rng(3)
    rows = [[(float(a), float(min(1, a + w))) for a, w in zip(rng.random(6).round(2), (rng.random(6) / 10).round(2), strict=True)] for _ in range(50)]
    for method in ("gap", "split"):
        for r, got, whole in zip(rows, run(spark, rows, lambda c, m=method: R.compress(c, 2, m)), run(spark, rows, R.union), strict=True):
            assert len(got) <= 2
            assert all(any(a <= lo + 1e-9 and hi <= b + 1e-9 for a, b in got) for lo, hi in r)
            gaps = sorted((b[0] - a[1] for a, b in zip(whole, whole[1:], strict=False)), reverse=True)
            if gaps:
                assert got[1][0] - got[0][1] == pytest.approx(gaps[0])


def test_active_edge_rules(spark):
    t = "array<struct<lo:tinyint,hi:tinyint>>"
    rows = [([], 0.5, True), ([(10, 30)], 0.1, True), ([(10, 30)], 0.3, True), ([(10, 30)], 0.31, False), ([(0, 0), (10, 90)], 0.5, False), ([(10, 20), (101, 110), (30, 60)], 0.5, False)]
    df = spark.createDataFrame([(i, r, a) for i, (r, a, _) in enumerate(rows)], f"id long, r {t}, a double")
    assert [x.ok for x in df.select("id", R.active(F.col("r"), F.col("a")).alias("ok")).orderBy("id").collect()] == [w for *_, w in rows]


def test_quantize_is_outward(spark):
    df = ranges(spark, [[(0.123, 0.456), (0.5, 0.6)]])
    assert [tuple(x) for x in df.select(R.quantize(F.col("r")).alias("r")).first().r] == [(12, 46), (50, 60)]


@settings(max_examples=200, deadline=None)
@given(st.integers(-5, 5), st.integers(-5, 5))
def test_solver_against_a_grid(s, r):
    got = _solve(float(s), float(r))
    for a in np.linspace(0, 1, 101):
        assert (s * a <= r + 1e-12) == (got is not None and got[0] - 1e-9 <= a <= got[1] + 1e-9)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=6))
def test_subtraction_against_a_grid(cuts):
    left = [(0.0, 20.0)]
    for a, b in cuts:
        left = _subtract(left, min(a, b), max(a, b))
    for k in range(20):
        mid = k + 0.5
        assert any(a < mid < b for a, b in left) == (not any(min(c) < mid < max(c) for c in cuts))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<float>, z array<float>, b array<float>")
    x = df.select(V.l2_sq(F.col("a"), F.col("b")).alias("d"), V.norm(F.col("a")).alias("n"), V.l2_normalize(F.col("z")).alias("z"), V.cosine_similarity(F.col("a"), F.col("b")).alias("c"),
                  V.cosine_similarity(F.col("a"), F.col("z")).alias("c0"), V.pad(F.col("a")).alias("p"), V.permute(F.col("a"), [1, 0]).alias("q")).first()
    assert (x.d, x.n, x.z, round(x.c, 9), x.c0, len(x.p), x.q) == (2.0, 5.0, [0.0, 0.0], 0.96, 0.0, 8, [4.0, 3.0])
    with pytest.raises(ValueError):
        V.metric("inner_product")


def test_share_is_undefined_at_zero(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.0), (0.25, 4.0, 0.0)], "a double, x double, y double")
    assert [r.s for r in df.select(V.contribution_share(F.col("a"), F.col("x"), F.col("y")).alias("s")).collect()] == [None, 1.0]


def test_scalars():
    assert [V.training_size(n) for n in (5, 1000, 10**9)] == [1, 100, 256_000]
    assert V.pq_chunks(64, 32e6, 1_000_000) == 32


def test_sql_functions(spark):
    registry.register(spark)
    assert spark.sql("SELECT fuse(0.5D, 4D, 9D) AS v").first().v == 2.5
    assert [tuple(r) for r in spark.sql("SELECT topk_pool(array(struct(2D AS dist, 1L AS id), struct(1D AS dist, 5L AS id), struct(1D AS dist, 5L AS id)), 2) AS p").first().p] == [(1.0, 5), (2.0, 1)]


def test_sql_functions_of_ranges(spark):
    registry.register(spark)
    r = "array(named_struct('lo', 0.7D, 'hi', 0.9D), named_struct('lo', 0.1D, 'hi', 0.2D), named_struct('lo', 0.15D, 'hi', 0.3D))"
    row = spark.sql(f"SELECT range_union({r}) u, range_complement({r}, 0.01D) c, range_quantise({r}) q, recall_at_k(array(1L, 2L, 2L, 9L), array(2L, 9L, 5L, 1L), 2) k, "
                    "alpha_active(array(named_struct('lo', 0D, 'hi', 0D), named_struct('lo', 0D, 'hi', 1D)), 0.5D) a").first()  # fmt: skip
    assert [tuple(x) for x in row.u] == [(0.1, 0.3), (0.7, 0.9)] and [tuple(x) for x in row.c] == [(0.0, 0.1), (0.3, 0.7), (0.9, 1.0)]
    assert [tuple(x) for x in row.q] == [(70, 90), (10, 20), (15, 30)] and row.k == 100.0 and row.a is False

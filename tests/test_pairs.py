"""Queries over all pairs of queries and rows go by blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinvec.operators import knn, metrics, skyline
from twinvec.plans import catalogue
from twinvec.plans import fixture as X


def no_row_pairs(spark, sf, name):
    """The plan joins no rows of the two sides, whose vectors would then be compared one by one."""
    plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_contribution_share_goes_by_blocks(spark, sf):
    no_row_pairs(spark, sf, "contribution_share")


@pytest.mark.parametrize("shipped", [knn.SHIPPED, 2])
def test_pairs_keep_odd_vectors(spark, monkeypatch, shipped):
    monkeypatch.setattr(knn, "SHIPPED", shipped)
    rows = [(0, [1.0, 2.0]), (1, [4.0, 6.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 0.0])]
    base = spark.createDataFrame(rows, "id long, x array<double>")
    q = base.where("id in (0, 2, 3)").select(F.col("id").alias("qid"), "x", F.lit(0.5).alias("alpha"))

    def emit(block):
        return catalogue._cells(block, block.known("x"), d=block.squares("x"))

    got = {(r.qid, r.id): r.d for r in knn.pairs(base, q, ("x",), emit, "qid long, id long, d double").collect()}
    assert set(got) == {(a, b) for a in (0, 2, 3) for b in range(6) if a != b}
    assert got[0, 1] == 25 and np.isnan(got[0, 5]) and {k for k, v in got.items() if v is not None} == {(0, 1), (0, 5)}


def test_l2_pairs_goes_by_blocks(spark, sf):
    no_row_pairs(spark, sf, "l2_pairs")


def test_cosine_pairs_goes_by_blocks(spark, sf):
    no_row_pairs(spark, sf, "cosine_pairs")


def test_skyline_layer0_goes_by_blocks(spark, sf):
    no_row_pairs(spark, sf, "skyline_layer0")


def test_layers_of_blocks_equal_layers_of_all(spark, sf, monkeypatch):
    """Also where blocks hand on too few layers at first, and where copies make long chains."""
    p = X.points(spark, sf).select("id", "x", "y").where("id < 150")
    p = p.crossJoin(spark.range(4).select(F.col("id").alias("s"))).select((F.col("id") + 150 * F.col("s")).alias("id"), "x", "y")
    q = p.where("id % 40 = 0").select(F.col("id").alias("qid"), "x", "y", F.lit(0.5).alias("alpha"))
    d = knn.pairs(p, q, ("x", "y"), lambda b: catalogue._cells(b, b.known("x"), d1=b.squares("x"), d2=b.squares("y")), "qid long, id long, d1 double, d2 double")
    want = sorted(map(tuple, skyline.truncate_layers(skyline.skyline_layers(d), 40).select("qid", "id", "d1", "d2", "layer").collect()))
    for depth, rows in ((12, 1 << 13), (2, 64), (1, 32)):
        monkeypatch.setattr(skyline, "DEPTH", depth)
        monkeypatch.setattr(skyline, "BLOCK_ROWS", rows)
        assert sorted(map(tuple, skyline.nearest_layers(p, q, 40, 6).collect())) == want


def test_skyline_layers_goes_by_blocks(spark, sf):
    no_row_pairs(spark, sf, "skyline_layers")


def test_order_statistics_in_passes(spark):
    rng = np.random.default_rng(3)
    v = np.round(np.concatenate((rng.random(5000), np.zeros(700), np.full(300, 0.25), 1e6 * rng.random(50), [np.nan] * 4)), 6)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)

    def values(emit, schema, done):
        def run(batches):
            for b in batches:
                state: dict = {}
                for part in np.array_split(b["v"].to_numpy(), 2):
                    emit(part, state)
                yield __import__("pandas").DataFrame(done(state))

        return df.mapInPandas(run, schema)

    want = np.sort(v[~np.isnan(v)])
    for gathered in (metrics.GATHERED, 0):
        metrics_gathered, metrics.GATHERED = metrics.GATHERED, gathered
        got, n, nan, total = metrics.ordered(values, lambda n: {0, 10, 699, 700, n // 2, n - 1})
        metrics.GATHERED = metrics_gathered
        assert (n, nan) == (len(want), 4) and total == pytest.approx(want.sum())
        assert got == {r: want[r] for r in got} and len(got) == 6


def test_stats_percentiles_writes_no_distances(spark, sf, monkeypatch):
    from twinvec.operators import layout

    monkeypatch.setattr(layout, "RANGE_ROWS", 1000)
    monkeypatch.setattr(layout, "written", None)  # a table of all distances would be written by ranges
    assert catalogue.queries()["stats_percentiles"](spark, sf).count() == 3


def test_distance_scale_summary_goes_by_blocks(spark, sf):
    no_row_pairs(spark, sf, "distance_scale_summary")

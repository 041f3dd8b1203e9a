"""Pareto layers over two distances, and entry points."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def skyline(df: DataFrame, partition: str = "qid", d1: str = "d1", d2: str = "d2", key: str = "id") -> DataFrame:
    """Rows whose d1 is below that of all rows before them in (d2, d1, id)."""
    w = W.partitionBy(partition).orderBy(d2, d1, key).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__least", F.min(d1).over(w)).where(F.col("__least").isNull() | (F.col(d1) < F.col("__least"))).drop("__least")


def layers_of(d1: list[float]) -> list[int]:
    """Layer of each point, given in (d2, d1, id) order, when the skyline is peeled
    off again and again: points before it that are no farther in d1 dominate it,
    so the layer is the length of the longest such chain."""
    ends: list[float] = []
    out = []
    for v in d1:
        k = bisect_right(ends, v)
        if k == len(ends):
            ends.append(v)
        else:
            ends[k] = v
        out.append(k)
    return out


def skyline_layers(df: DataFrame, partition: str = "qid", d1: str = "d1", d2: str = "d2", key: str = "id") -> DataFrame:
    """Adds layer (0 is the skyline). A partition is one candidate pool."""
    schema = f"{partition} long, {key} long, {d1} double, {d2} double, layer long"

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([d2, d1, key])
        return pdf.assign(layer=layers_of(pdf[d1].tolist()))[[partition, key, d1, d2, "layer"]]

    return df.select(partition, key, d1, d2).groupBy(partition).applyInPandas(peel, schema)


def peeled(d1: np.ndarray, d2: np.ndarray, ids: np.ndarray, layers: int) -> np.ndarray:
    """The first layers of each line of two matrices of distances: -1 for what lies deeper or has no finite distances."""
    left = np.isfinite(d1) & np.isfinite(d2)
    order = np.lexsort((np.broadcast_to(ids, d1.shape), d1, d2), axis=1)
    v = np.take_along_axis(np.where(left, d1, np.inf), order, 1)
    got = np.full(d1.shape, -1)
    for k in range(layers):
        least = np.minimum.accumulate(v, axis=1)
        first = v < np.concatenate((np.full((len(v), 1), np.inf), least[:, :-1]), axis=1)
        if not first.any():
            break
        got[first], v[first] = k, np.inf
    out = np.empty_like(got)
    np.put_along_axis(out, order, got, 1)
    return out


#: Layers that a block of rows hands on at first, and rows of a block.
DEPTH, BLOCK_ROWS = 12, 1 << 13


def _peeled_pairs(base: DataFrame, queries: DataFrame, layers: int, digits: int) -> DataFrame:
    """qid, id, d1, d2, layer: of each block of rows the first layers to each query."""
    from twinvec.operators import knn

    def emit(block):
        d1, d2 = (np.where(block.known(c), knn.half_up(block.squares(c), digits), np.inf) for c in "xy")
        layer = peeled(d1, d2, block.ids, layers)
        i, j = np.nonzero(layer >= 0)
        return {"qid": block.qid[i], "id": block.ids[j], "d1": d1[i, j], "d2": d2[i, j], "layer": layer[i, j]}

    return knn.pairs(base, queries, ("x", "y"), emit, "qid long, id long, d1 double, d2 double, layer long", rows_each=BLOCK_ROWS)


def nearest_skyline(base: DataFrame, queries: DataFrame, digits: int) -> DataFrame:
    """base (id, x, y), queries (qid, alpha, x, y) -> qid, id, d1, d2: the skyline of each query's squared distances, from
    the skylines of blocks of rows."""
    return skyline(_peeled_pairs(base, queries, 1, digits).drop("layer"))


def nearest_layers(base: DataFrame, queries: DataFrame, pool: int, digits: int) -> DataFrame:
    """Whole layers of each query's squared distances while fewer than `pool` rows are before them -> qid, id, d1, d2, layer.

    Blocks of rows hand on their first layers. What a block kept back is dominated by a row of the last layer that it handed on,
    so it lies deeper than the least layer that such a row gets among all that were handed on; layers up to there are exact. Queries
    to which that is too few are asked again for `pool` layers a block, which always do: no layer is empty."""
    from twinvec.scratch import written

    def some(asked: DataFrame, depth: int) -> DataFrame:
        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["d2", "d1", "id"])
            layer = np.array(layers_of(pdf["d1"].tolist()))
            last = layer[pdf["layer"].to_numpy() == depth - 1]
            exact = last.min() + 1 if len(last) else len(layer) + 1
            before = np.concatenate(([0], np.cumsum(np.bincount(layer))))[layer]
            enough = not len(last) or (layer < exact).sum() >= pool
            return pdf.assign(layer=layer, whole=enough)[before < pool if enough else np.arange(len(layer)) == 0]

        return _peeled_pairs(base, asked, depth, digits).groupBy("qid").applyInPandas(merge, "qid long, id long, d1 double, d2 double, layer long, whole boolean")

    depth = min(DEPTH, pool)
    got = written(some(queries, depth), "layers")
    short = got.where("not whole").select("qid").distinct()
    out = got.where("whole")
    if depth < pool and not short.isEmpty():
        out = out.union(some(queries.join(short, "qid", "left_semi"), pool))
    return out.select("qid", "id", "d1", "d2", "layer")


def truncate_layers(df: DataFrame, pool: int, partition: str = "qid") -> DataFrame:
    """Whole layers while fewer than `pool` rows are before them."""
    sizes = df.groupBy(partition, "layer").agg(F.count("*").alias("__n"))
    w = W.partitionBy(partition).orderBy("layer").rowsBetween(W.unboundedPreceding, -1)
    keep = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).where(F.col("__before") < pool)
    return df.join(keep.select(partition, "layer"), [partition, "layer"])


def entry_points(df: DataFrame, d1: str = "d1", d2: str = "d2", key: str = "id", buckets: int = 64) -> DataFrame:
    """The far skyline: scanning from the largest d2, rows whose d1 exceeds all before.
    Each part of the rows is thinned first; the scan sees what is left."""
    out = df.withColumn("__one", F.pmod(F.xxhash64(key), F.lit(buckets)))
    for part in (["__one"], []):
        w = W.partitionBy(*[F.col(c) for c in part]).orderBy(F.desc(d2), F.desc(d1), key).rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn("__most", F.max(d1).over(w)).where(F.coalesce(F.col(d1) > F.col("__most"), F.col(d1) > 0)).drop("__most")
    return out.drop("__one")


def rerank_size(p: Column, pool: Column, size: Column) -> Column:
    """How many candidates are scored exactly: max(p, ceil(p * (1 + log10(L / p)))), at
    most L and the pool's size."""
    n = F.greatest(p, F.ceil(p * (1 + F.log10(pool / p))))
    return F.least(n, pool, size).cast("long")

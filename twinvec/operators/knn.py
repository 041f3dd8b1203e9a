"""Exact nearest neighbours in one or two spaces, by blocks.

Few queries go to the executors in blocks of bounded size; beyond SHIPPED of them, blocks of
rows meet blocks of queries in tasks, and nothing passes the driver. Each task scores its rows against a block with matrix products, computes the
distances of all that may be among the best anew, without the expansion's error, and holds
the best k of its rows; a window keeps the best k of all tasks. Ties go to the smaller id, also where
many rows have one distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
#: Queries that go through the driver at most, and rows of a block beyond.
SHIPPED, ROW_BLOCK = 1 << 14, 1 << 14
OBJECTIVES = ("fused", "fused_sq", "x", "y", "concat")
_OUT = "qid long, id long, dist double"


def _stack(col) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _score(objective: str, alpha, dx2, dy2):
    if objective == "fused":
        return alpha * np.sqrt(np.maximum(0, dx2)) + (1 - alpha) * np.sqrt(np.maximum(0, dy2))
    if objective == "fused_sq":
        return alpha * dx2 + (1 - alpha) * dy2
    if objective == "x":
        return np.sqrt(np.maximum(0, dx2))
    if objective == "y":
        return np.sqrt(np.maximum(0, dy2))
    if objective == "concat":
        return np.sqrt(np.maximum(0, dx2 + dy2))
    raise ValueError(f"objective {objective!r}: use one of {OBJECTIVES}")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def exact_dual_knn(base: DataFrame, queries: DataFrame, k: int = 10, objective: str = "fused", exclude_self: bool = True, digits: int | None = None) -> DataFrame:
    """base (id, x, y), queries (qid, x, y, alpha) -> qid, alpha, rank, id, dist."""
    if objective not in OBJECTIVES:
        raise ValueError(f"objective {objective!r}: use one of {OBJECTIVES}")
    spark = base.sparkSession
    q = queries.select("qid", "x", "y", F.col("alpha").cast("double").alias("alpha"))
    rows = q.limit(SHIPPED + 1).orderBy("qid", "alpha").collect()
    if len(rows) > SHIPPED:
        out = _meet(base, q, k, objective, exclude_self, digits)
    else:
        out = None
        for a in range(0, max(len(rows), 1), QUERY_BLOCK):
            got = _block(base, spark, rows[a : a + QUERY_BLOCK], k, objective, exclude_self, digits)
            out = got if out is None else out.union(got)
    w = W.partitionBy("qid", "alpha").orderBy("dist", "id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "alpha", "rank", "id", "dist")


#: What the expansion of a square may be off by, as a share of the squares' sizes.
EXPANSION = 1e-12


def _best(qid, alpha, qx, qy, batches, k: int, objective: str, exclude_self: bool, digits: int | None) -> pd.DataFrame:
    """The k best rows of the batches for each query."""
    most = np.iinfo(np.int64).max
    best_d, best_id = np.full((len(qid), k), np.inf), np.full((len(qid), k), most)
    for pdf in batches:
        if not len(pdf) or not len(qid):
            continue
        ids, x, y = pdf["id"].to_numpy(), _stack(pdf["x"]), _stack(pdf["y"])
        for a in range(0, len(qid), 256):
            s = slice(a, a + 256)
            dx2, dy2 = _squares(qx[s], x), _squares(qy[s], y)
            score = _score(objective, alpha[s, None], dx2, dy2)
            # The least that a distance can be, given the expansion's error.
            slack = [EXPANSION * ((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] + 1) for q, v in ((qx[s], x), (qy[s], y))]
            least = _score(objective, alpha[s, None], np.maximum(0, dx2 - slack[0]), np.maximum(0, dy2 - slack[1]))
            upper = _score(objective, alpha[s, None], np.maximum(0, dx2) + slack[0], np.maximum(0, dy2) + slack[1])
            if exclude_self:
                own = qid[s, None] == ids[None, :]
                score[own] = least[own] = upper[own] = np.inf
            n = min(len(ids), k)
            bar = np.minimum(np.partition(upper, n - 1, axis=1)[:, n - 1] if n == k else np.inf, best_d[s, -1])
            if digits is not None:
                bar = bar + 2 * 10.0**-digits
            i, j = np.nonzero((least <= np.broadcast_to(bar, least.shape[:1])[:, None]) & np.isfinite(score))
            d = _score(objective, alpha[s][i], ((qx[s][i] - x[j]) ** 2).sum(1), ((qy[s][i] - y[j]) ** 2).sum(1))
            if digits is not None:
                d = np.round(d, digits)
            order = np.lexsort((ids[j], d, i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, d, rank = i[rank < k], j[rank < k], d[rank < k], rank[rank < k]
            new_d, new_id = np.full((len(best_d[s]), k), np.inf), np.full((len(best_d[s]), k), most)
            new_d[i, rank], new_id[i, rank] = d, ids[j]
            both_d, both_id = np.concatenate((best_d[s], new_d), axis=1), np.concatenate((best_id[s], new_id), axis=1)
            first = np.lexsort((both_id, both_d), axis=1)[:, :k]
            best_d[s], best_id[s] = np.take_along_axis(both_d, first, 1), np.take_along_axis(both_id, first, 1)
    i, j = np.nonzero(np.isfinite(best_d))
    return pd.DataFrame({"qid": qid[i], "alpha": alpha[i], "id": best_id[i, j], "dist": best_d[i, j]})


def _meet(base: DataFrame, queries: DataFrame, k: int, objective: str, exclude_self: bool, digits: int | None) -> DataFrame:
    """Every block of queries meets every block of rows in a task of its own: either side is sent
    once a block of the other, and a task holds one block of each."""
    nb, nq = (max(1, -(-df.count() // ROW_BLOCK)) for df in (base, queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    b = base.select("id", "x", "y", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("rb")).withColumn("qb", every(nq))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("qid", "alpha"), F.lit(nq)).cast("int")).withColumn("rb", every(nb))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values(["qid", "alpha"])
        if not len(asked) or not len(rows):
            return pd.DataFrame({"qid": [], "alpha": [], "id": [], "dist": []})
        parts = (rows.iloc[a : a + QUERY_BLOCK] for a in range(0, len(rows), QUERY_BLOCK))
        return _best(asked["qid"].to_numpy(), asked["alpha"].to_numpy(), _stack(asked["x"]), _stack(asked["y"]), parts, k, objective, exclude_self, digits)

    return b.groupBy("rb", "qb").cogroup(q.groupBy("rb", "qb")).applyInPandas(run, "qid long, alpha double, id long, dist double")


def _block(base: DataFrame, spark, block: list, k: int, objective: str, exclude_self: bool, digits: int | None) -> DataFrame:
    shared = spark.sparkContext.broadcast(
        (np.array([r.qid for r in block], np.int64), np.array([r.alpha for r in block]), _stack([r.x for r in block]) if block else None, _stack([r.y for r in block]) if block else None)
    )

    def run(batches):
        yield _best(*shared.value, batches, k, objective, exclude_self, digits)

    return base.select("id", "x", "y").mapInPandas(run, "qid long, alpha double, id long, dist double")


#: Rows of a block of pairs, its cells, whose matrices stay within a core's cache, and rows of a task beyond SHIPPED queries.
PAIR_ROWS, PAIR_CELLS, PAIR_BATCH = 1 << 11, 1 << 15, 1 << 13


def _padded(col) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix, padded with zeros, and their lengths: -1 for one that is null or holds a null."""
    size = np.array([-1 if v is None or any(e is None for e in v) else len(v) for v in col], np.int64)
    out = np.zeros((len(size), max([1, *size.tolist()])))
    for i, v in enumerate(col):
        if size[i] > 0:
            out[i, : size[i]] = v
    return out, size


def _arrow_vectors(col) -> tuple[np.ndarray, np.ndarray]:
    """_padded() of an Arrow list column; vectors of one length are taken as they lie."""
    import pyarrow as pa

    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, ends = col.flatten(), np.asarray(col.offsets)
    size = np.diff(ends)
    if len(col) and not col.null_count and not flat.null_count and size[0] > 0 and (size == size[0]).all():
        return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(col), size[0]), size.astype(np.int64)
    return _padded(col.to_pylist())


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """Rounded, halves away from zero as in SQL; zero has no sign."""
    t = np.abs(v) * 10.0**digits
    low = np.floor(t)
    with np.errstate(invalid="ignore"):
        out = np.where(np.isfinite(t), (low + (t - low >= 0.5)) / 10.0**digits, np.abs(v))
    return np.copysign(out, v) + 0.0


class Block:
    """Some queries against some rows: qid, alpha, ids, and matrices by query and row. Sums run in the order of the dimensions,
    so they equal those of SQL to the last bit. A value is undefined, NaN and not `known`, where V.l2_sq is null."""

    def __init__(self, qid, alpha, q, ids, p):
        self.qid, self.alpha, self.ids, self._q, self._p = qid, alpha[:, None], ids, q, p
        self.other = qid[:, None] != ids[None, :]

    def known(self, *names: str) -> np.ndarray:
        out = self.other
        for n in names:
            a, b = self._q[n][1][:, None], self._p[n][1][None, :]
            out = out & (a == b) & (a >= 0)
        return out

    def _sum(self, name: str, term) -> np.ndarray:
        q, p = self._q[name][0], self._p[name][2]
        out = np.zeros((len(self.qid), len(self.ids)))
        part = np.empty_like(out)
        for i in range(min(q.shape[1], len(p))):
            term(q[:, i, None], p[i][None, :], out=part)
            out += part
        return out

    def squares(self, name: str) -> np.ndarray:
        def term(a, b, out):
            np.subtract(a, b, out=out)
            np.multiply(out, out, out=out)

        return self._sum(name, term)

    def dots(self, name: str) -> np.ndarray:
        return self._sum(name, np.multiply)

    def norms(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Norms of the queries and of the rows, to be multiplied as a column and a row."""
        return tuple(np.sqrt(sum(c * c for c in m.T) + np.zeros(len(m))) for m in (self._q[name][0], self._p[name][2].T))


def pairs(base: DataFrame, queries: DataFrame, spaces: tuple[str, ...], emit, schema: str, done=None, rows_each: int = PAIR_ROWS) -> DataFrame:
    """Every query with every other row, by blocks in tasks: base (id, *spaces), queries (qid, alpha, *spaces), spaces of
    vectors. emit(Block) -> a dictionary of arrays by column of the schema, for the rows of one block; or, with done,
    emit(Block, state) adds to a dictionary of the task, and done(state) gives the rows of a batch. Up to SHIPPED queries go to the tasks;
    more meet the rows in blocks of a join."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    spark = base.sparkSession
    q = queries.select("qid", F.col("alpha").cast("double").alias("alpha"), *spaces)
    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def blocks(asked, rows):
        qid, alpha, qv = asked
        ids, pv = rows
        for a in range(0, len(ids), rows_each):
            r = slice(a, a + rows_each)
            p = {n: (m[r], size[r], np.ascontiguousarray(m[r].T)) for n, (m, size) in pv.items()}
            for b in range(0, len(qid), PAIR_CELLS // rows_each):
                t = slice(b, b + PAIR_CELLS // rows_each)
                yield Block(qid[t], alpha[t], {n: (m[t], size[t]) for n, (m, size) in qv.items()}, ids[r], p)

    def table(found: dict):
        return pa.table([c if isinstance(c := found[k.name], pa.Array) else pa.array(c, k.type) for k in kinds], schema=kinds)

    def run(asked, rows):
        with np.errstate(all="ignore"):
            if done is None:
                for block in blocks(asked, rows):
                    yield from table(emit(block)).to_batches()
            else:
                state: dict = {}
                for block in blocks(asked, rows):
                    emit(block, state)
                if state:
                    yield from table(done(state)).to_batches()

    def vectors(t):
        return {n: _arrow_vectors(t[n]) for n in spaces}

    few = q.limit(SHIPPED + 1).toArrow()
    if len(few) <= SHIPPED:
        few = few.sort_by([("qid", "ascending")])
        shared = spark.sparkContext.broadcast((few["qid"].to_numpy(), few["alpha"].to_numpy(), vectors(few)))

        def meet(batches):
            for t in batches:
                if len(t):
                    yield from run(shared.value, (t["id"].to_numpy(zero_copy_only=False), vectors(t)))

        return _spread(base.select("id", *spaces)).mapInArrow(meet, schema)
    nb, nq = (max(1, -(-df.count() // n)) for df, n in ((base, PAIR_BATCH), (q, SHIPPED)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    b = base.select("id", *spaces, F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("rb")).withColumn("qb", every(nq))
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("rb", every(nb))

    def group(left, right):
        right = right.sort_by([("qid", "ascending")])
        got = run((right["qid"].to_numpy(), right["alpha"].to_numpy(), vectors(right)), (left["id"].to_numpy(), vectors(left))) if len(left) and len(right) else ()
        return pa.Table.from_batches(got, kinds)

    return b.groupBy("rb", "qb").cogroup(q.groupBy("rb", "qb")).applyInArrow(group, schema)


def _spread(df: DataFrame) -> DataFrame:
    """A small table lies in few files, while its pairs are work for all cores."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * parts, -(-df.count() // PAIR_BATCH)), "id")


def exact_knn(base: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = True, digits: int | None = None) -> DataFrame:
    """One space: base (id, vec), queries (qid, vec) -> qid, rank, id, dist."""
    b = base.select("id", F.col("vec").alias("x"), F.col("vec").alias("y"))
    q = queries.select("qid", F.col("vec").alias("x"), F.col("vec").alias("y"), F.lit(1.0).alias("alpha"))
    return exact_dual_knn(b, q, k, "x", exclude_self, digits).drop("alpha")


#: Rows that are compared with all centers at a time.
CENTER_ROWS = 512


def _nearest(x: np.ndarray, cv: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centers of each row; the first of equally near ones."""
    d2 = np.round(np.maximum(0, _squares(x, cv)), 12)
    out = np.empty((len(x), n), np.int64)
    for j in range(n):  # few of many: no order of all centers
        out[:, j] = d2.argmin(1)
        d2[np.arange(len(x)), out[:, j]] = np.inf
    return out


def assign_centers(points: DataFrame, centers: DataFrame, k: int = 1) -> DataFrame:
    """points (id, vec), centers (cid, vec): the k nearest centers of each point ->
    id, rank, cid, d2. Centers are a codebook or shard centers: bounded by their
    number, which is checked."""
    c = centers.select("cid", "vec").orderBy("cid").limit(1 << 16).collect()
    if len(c) == 1 << 16:
        raise ValueError("at most 65535 centers")
    shared = points.sparkSession.sparkContext.broadcast((np.array([r.cid for r in c], np.int64), _stack([r.vec for r in c])))

    def run(batches):
        cid, cv = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = _stack(pdf["vec"])
            n = min(k, len(cid))
            order = np.concatenate([_nearest(x[a : a + CENTER_ROWS], cv, n) for a in range(0, len(x), CENTER_ROWS)])
            i = np.repeat(np.arange(len(x)), n)
            j = order.ravel()
            exact = ((x[i] - cv[j]) ** 2).sum(1)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "rank": np.tile(np.arange(1, n + 1), len(x)), "cid": cid[j], "d2": exact})

    return points.select("id", "vec").mapInPandas(run, "id long, rank long, cid long, d2 double")


def top_k(df: DataFrame, k: int, partition="qid", order=("dist", "id")) -> DataFrame:
    w = W.partitionBy(partition).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def dual_union_rerank(base: DataFrame, queries: DataFrame, k: int = 10, kx: int = 10, ky: int = 10, digits: int | None = None) -> DataFrame:
    """Nearest by x together with nearest by y, without repeats, ranked by the fused
    distance -> qid, rank, id, dist."""
    x = exact_dual_knn(base, queries, kx, "x").select("qid", "id")
    y = exact_dual_knn(base, queries, ky, "y").select("qid", "id")
    return rerank(x.union(y).distinct(), base, queries, k, digits)


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int = 10, digits: int | None = None) -> DataFrame:
    """(qid, id) -> the best k by the exact fused distance."""
    from twinvec.functions import vector as V

    q = queries.select("qid", F.col("x").alias("qx"), F.col("y").alias("qy"), "alpha")
    c = candidates.join(q, "qid").join(base.select("id", "x", "y"), "id")
    d = V.fuse(F.col("alpha"), V.l2_sq(F.col("qx"), F.col("x")), V.l2_sq(F.col("qy"), F.col("y")))
    return top_k(c.select("qid", "id", (F.round(d, digits) if digits is not None else d).alias("dist")), k).select("qid", "rank", "id", "dist")

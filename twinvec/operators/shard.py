"""Shards of bounded size, graphs over them, samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinvec.operators import graph, knn, pq
from twinvec.scratch import written

SAMPLE_ROWS, BLOCK = 20_000, 256


def random_slice(df: DataFrame, p: float, seed: int = 42, key: str = "id") -> DataFrame:
    """Each row with probability p, by the first 32 bits of the MD5 of "seed:key": the same rows
    in every run, in every engine and however the table is laid out."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32) < p)


def first_centers(points: DataFrame, k: int) -> DataFrame:
    """The vectors of the k smallest ids as centers -> cid, vec."""
    f = points.orderBy("id").limit(k)
    return f.select((F.row_number().over(W.orderBy("id")) - 1).cast("long").alias("cid"), "vec")


def kmeans_centers(points: DataFrame, k: int, seed: int = 42, rounds: int = 20) -> DataFrame:
    """k-means over a bounded sample -> cid, vec."""
    n = points.count()
    rows = random_slice(points, min(1.0, SAMPLE_ROWS / max(n, 1)), seed).orderBy("id").limit(2 * SAMPLE_ROWS).toPandas()
    c = pq.kmeans(np.stack([np.asarray(v, np.float64) for v in rows["vec"]]), k, seed, rounds)
    return points.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cid long, vec array<double>")


def cluster_sizes(points: DataFrame, centers: DataFrame, sample: float = 1.0, seed: int = 42) -> DataFrame:
    """cid, n: rows a cluster, estimated from a sample if it is below 1."""
    p = random_slice(points, sample, seed) if sample < 1 else points
    a = knn.assign_centers(p, centers, 1)
    return a.groupBy("cid").agg(F.round(F.count("*") / sample).cast("long").alias("n"))


def partition_with_budget(points: DataFrame, max_rows: int, copies: int = 1, seed: int = 42, sample: float = 1.0, start: int = 3, most: int = 4096) -> DataFrame:
    """(id, vec) -> id, rank, cid: each row in its `copies` nearest of as many shards as
    keep every estimated shard within max_rows. Shards that centers cannot cut,
    such as equal vectors, are cut by hash: (cid, part)."""
    n = points.count()
    k = max(start, -(-n * copies // max_rows))
    while True:
        centers = kmeans_centers(points, k, seed)
        a = written(knn.assign_centers(random_slice(points, sample, seed) if sample < 1 else points, centers, copies), "assigned")
        worst = a.groupBy("cid").agg((F.count("*") / sample).alias("n")).agg(F.max("n")).first()[0] or 0
        bound = min(most, 4 * max(start, -(-n * copies // max_rows)))
        if worst <= max_rows or k >= bound:
            break
        # By a quarter, so a large table's rows are assigned a few times, not once for each further shard.
        k = min(bound, max(k + 1, k * 5 // 4))
    if sample < 1:
        a = knn.assign_centers(points, centers, copies)
    sizes = a.groupBy("cid").agg(F.ceil(F.count("*") / max_rows).alias("parts"))
    a = a.join(sizes, "cid").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("long"))
    return a.select("id", "rank", "cid", "part")


def _edges_inside(pdf: pd.DataFrame, degree: int, pool: int) -> pd.DataFrame:
    """Edges among the rows of one shard."""
    pdf = pdf.sort_values("id").drop_duplicates("id")
    ids, x, y = pdf["id"].to_numpy(), *(np.stack([np.asarray(v, np.float64) for v in pdf[c]]) for c in "xy")
    src, dst = [], []
    for start in range(0, len(ids), BLOCK):  # distances of a block of rows at a time
        s = slice(start, start + BLOCK)
        d1, d2 = (np.sqrt(np.maximum(0, (m[s] * m[s]).sum(1)[:, None] - 2 * m[s] @ m.T + (m * m).sum(1)[None])) for m in (x, y))
        for i in range(len(d1)):
            near: set[int] = set()
            for a in graph.ALPHAS:
                d = a * d1[i] + (1 - a) * d2[i]
                d[start + i] = np.inf
                near.update(np.argsort(d, kind="stable")[: min(pool, len(ids) - 1)].tolist())
            c = np.array(sorted(near), dtype=np.int64)
            for j, _, _ in graph.prune_dual(ids[c], d1[i, c], d2[i, c], x[c], y[c], degree) if len(c) else []:
                src.append(ids[start + i])
                dst.append(ids[c[j]])
    return pd.DataFrame({"src": src, "dst": dst}, dtype="int64")


def build_sharded(points: DataFrame, max_rows: int = 20_000, degree: int = 32, pool: int = 64, copies: int = 1, seed: int = 42, **pruning) -> DataFrame:
    """(id, x, y) -> dual graph: shards by x and shards by y are built apart, each shard in
    one task, and their edges merged and pruned per source."""
    parts = []
    for space in "xy":
        s = partition_with_budget(points.select("id", F.col(space).alias("vec")), max_rows, copies, seed)
        rows = s.select("id", "cid", "part").join(points.select("id", "x", "y"), "id")
        parts.append(rows.groupBy("cid", "part").applyInPandas(lambda pdf: _edges_inside(pdf, degree, pool), "src long, dst long"))
    e = written(parts[0].union(parts[1]).distinct(), "shard-edges")
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.dual_edges(both, points, degree, **pruning)


def build_single_sharded(points: DataFrame, max_rows: int = 20_000, degree: int = 32, pool: int = 64, alpha: float = 1.2, copies: int = 2, seed: int = 42) -> DataFrame:
    """(id, vec) -> src, pos, dst: overlapping shards, each built in a task with two thirds of the degree,
    and merged."""
    inside = 2 * max(1, degree // 3)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates("id")
        ids, v = pdf["id"].to_numpy(), np.stack([np.asarray(r, np.float64) for r in pdf["vec"]])
        near: dict[int, set] = {i: set() for i in range(len(ids))}
        square = (v * v).sum(1)

        def choose(i: int, c: np.ndarray) -> list[int]:
            d = np.sqrt(((v[c] - v[i]) ** 2).sum(1))
            return c[graph.prune_slack(ids[c], d, lambda a, b: float(np.sqrt(((v[c[a]] - v[c[b]]) ** 2).sum())), inside, alpha)].tolist()

        for start in range(0, len(ids), BLOCK):
            d = square[start : start + BLOCK, None] - 2 * v[start : start + BLOCK] @ v.T + square[None]
            for i in range(len(d)):
                d[i, start + i] = np.inf
                c = np.sort(np.argsort(d[i], kind="stable")[: min(pool, len(ids) - 1)])
                for j in choose(start + i, c) if len(c) else []:
                    near[start + i].add(j)
                    near[j].add(start + i)
        out = [(ids[i], ids[j]) for i, c in near.items() if c for j in (sorted(c) if len(c) <= graph.SLACK * inside else choose(i, np.array(sorted(c))))]
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    s = partition_with_budget(points, max_rows, copies, seed)
    rows = s.select("id", "cid", "part").join(points.select("id", "vec"), "id")
    return merge_shards(rows.groupBy("cid", "part").applyInPandas(build, "src long, dst long"), degree, seed)


def merge_shards(shards: DataFrame, degree: int, seed: int = 42) -> DataFrame:
    """(src, dst) of overlapping one-space shards -> src, pos, dst: repeats go, and each
    source keeps `degree` edges in a seeded order."""
    w = W.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "dst")
    u = shards.select("src", "dst").where("src <> dst").distinct()
    return u.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= degree).select("src", "pos", "dst")

"""Near-duplicate vectors of one label: all pairs of cosine >= threshold, by dual
traversal of cover trees.

Vectors are scaled to length 1, where cosine c is distance sqrt(2 - 2c). Labels
of more than CELL vectors are cut into cells around pivots (about n / CELL of
them, by hash); cells that are still larger, such as a cluster of near copies,
into blocks by hash. Two blocks of a label meet in a task unless the distance of
their pivots, less their covering radii, exceeds the threshold's.

A task builds a cover tree on each side: nested levels whose radii halve, every
node covering its points within its radius. It walks both trees at once from
the roots: children are compared with one matrix product, pairs whose distance
less both radii is beyond the threshold are dropped, pairs whose distance plus
both radii is within it are taken whole, without listing their points, and what
remains at the leaves is compared exactly. Out go a count and a local root for
each vector with links, never the pairs.

A vector that is null, zero, or holds null or non-finite components, or whose
label is null, links with nothing, and vectors of different lengths do not link.
Repeated rows are separate vectors. Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm.common import components, roots, written

THRESHOLD = 0.93
CELL, LEAF = 2048, 48
#: Bounds of what is broadcast: keys that get pivots, and pivots in all.
MAX_KEYS, MAX_PIVOTS = 4096, 32768
SLACK = 1e-9


class CoverTree:
    """Nodes over unit vectors: centre, radius (largest distance of a point from the
    centre), the range of the node's points in `order`, and its children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.order = np.arange(len(x))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        first = np.sqrt(np.maximum(0, 2 - 2 * (x @ x[0])))
        todo = [(self._node(0, float(first.max()), 0, len(x)), float(first.max()))]
        while todo:
            node, bound = todo.pop()
            a, b = self.span[node]
            if b - a <= leaf or self.radius[node] < 1e-6:
                continue
            half, own = bound / 2, self.order[a:b]
            rest, groups = np.arange(len(own)), []
            at = np.flatnonzero(own == self.centre[node])[0]  # nested: the centre stays a centre below
            while len(rest):
                pick = at if not groups else rest[0]
                d = np.sqrt(np.maximum(0, 2 - 2 * (x[own[rest]] @ x[own[pick]])))
                near = d <= half
                near[rest == pick] = True
                groups.append((own[pick], own[rest[near]], float(d[near].max())))
                rest = rest[~near]
            for c, members, r in groups:
                self.order[a : a + len(members)] = members
                child = self._node(int(c), r, a, a + len(members))
                self.children[node].append(child)
                a += len(members)
                todo.append((child, half))

    def _node(self, centre: int, radius: float, a: int, b: int) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.span.append((a, b))
        self.children.append([])
        return len(self.centre) - 1

    def points(self, node: int) -> np.ndarray:
        a, b = self.span[node]
        return self.order[a:b]


def dual_links(s: CoverTree, t: CoverTree, same: bool, threshold: float):
    """-> links of points of s, of t, and pairs (i, j) that connect what is linked:
    of pairs of nodes taken whole, only a star."""
    limit = np.sqrt(2 - 2 * threshold)
    count_s, count_t = np.zeros(len(s.x), np.int64), np.zeros(len(t.x), np.int64)
    left, right = [], []
    rs, rt = np.array(s.radius), np.array(t.radius)

    def exact(p: np.ndarray, q: np.ndarray, diagonal: bool) -> None:
        for k in range(0, len(p), 512):
            hit = s.x[p[k : k + 512]] @ t.x[q].T >= threshold
            if diagonal:
                hit &= p[k : k + 512, None] != q[None, :]
            i, j = np.nonzero(hit)
            if len(i):
                np.add.at(count_s, p[k + i], 1)
                if not diagonal:
                    np.add.at(count_t, q[j], 1)
                left.append(p[k + i])
                right.append(q[j])

    def whole(a: int, b: int) -> None:
        p, q = s.points(a), t.points(b)
        if same and a == b:
            count_s[p] += len(p) - 1
        else:
            count_s[p] += len(q)
            count_t[q] += len(p)
        left.extend((np.full(len(q), p[0]), p))
        right.extend((q, np.full(len(p), q[0])))

    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        ca, cb = s.children[a] or [a], t.children[b] or [b]
        if ca == [a] and cb == [b]:
            exact(s.points(a), t.points(b), same and a == b)
            continue
        ca, cb = np.array(ca), np.array(cb)
        xs, xt = s.x[np.array(s.centre)[ca]], t.x[np.array(t.centre)[cb]]
        for k in range(0, len(ca), 512):
            d = np.sqrt(np.maximum(0, 2 - 2 * (xs[k : k + 512] @ xt.T)))
            radii = rs[ca[k : k + 512], None] + rt[None, cb]
            i, j = np.nonzero(d - radii <= limit + SLACK)
            inside = (d[i, j] + radii[i, j]) <= limit - SLACK
            for u, v, full in zip(ca[k + i].tolist(), cb[j].tolist(), inside.tolist(), strict=True):
                if same and a == b and u > v:
                    continue  # the pair comes the other way round, too
                if full:
                    whole(u, v)
                else:
                    todo.append((u, v))
    if same:
        # Off the diagonal each pair of nodes was seen once: both ends were counted, on either side.
        count_s += count_t
        count_t = np.zeros_like(count_t)
    none = np.zeros(0, np.int64)
    return count_s, count_t, np.concatenate(left or [none]), np.concatenate(right or [none])


def _matrix(col: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in col])
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    usable = F.exists("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) > 0) & (F.abs(v) < float("inf"))) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    base = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    key = F.when(F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)), F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string")))
    base = written(base.withColumn("key", key).withColumn("uid", F.monotonically_increasing_id()).drop("label"), "vectors")
    sizes = written(base.where("key is not null").groupBy("key").agg(F.count("*").alias("n")), "keys")
    large = {r.key: r.n for r in sizes.where(F.col("n") > cell).orderBy(F.desc("n"), "key").limit(MAX_KEYS).collect()}
    wanted = sum(-(-n // cell) for n in large.values())
    part = min(1.0, MAX_PIVOTS / wanted) / cell if wanted else 0.0
    pivots: dict[str, list] = {}
    if large:
        chance = F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
        picked = base.join(F.broadcast(spark.createDataFrame([(k,) for k in large], "key string")), "key").where(chance < 1.5 * part)
        for r in picked.select("key", "uid", "embedding").orderBy("uid").limit(2 * MAX_PIVOTS).toLocalIterator():
            pivots.setdefault(r.key, []).append(r.embedding)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        unit = {k: _matrix(pd.Series(v)) for k, v in shared.value.items()}
        for pdf in batches:
            spot, dist = np.zeros(len(pdf), np.int64), np.full(len(pdf), 2.0)
            for k, at in pdf.groupby("key").indices.items():
                if k in unit:
                    x = _matrix(pdf["embedding"].iloc[at])
                    sim = x @ unit[k].T
                    spot[at] = sim.argmax(axis=1)
                    dist[at] = np.sqrt(np.maximum(0, 2 - 2 * sim[np.arange(len(at)), spot[at]]))
            yield pd.DataFrame({"uid": pdf["uid"], "key": pdf["key"], "cell": spot, "dist": dist, "embedding": pdf["embedding"]})

    placed = base.where("key is not null").select("uid", "key", "embedding").mapInPandas(assign, "uid long, key string, cell long, dist double, embedding array<double>")
    placed = written(placed, "placed")
    cells = written(placed.groupBy("key", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")), "cells")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of blocks of one label that may hold a link."""
        k, limit = pdf["key"].iloc[0], np.sqrt(2 - 2 * threshold)
        unit = _matrix(pd.Series(shared.value[k])) if k in shared.value else None
        blocks = [(c, b, nb, r) for c, n, r in sorted(zip(pdf["cell"], pdf["n"], pdf["radius"], strict=True)) for nb in [-(-n // cell)] for b in range(nb)]
        out = []
        for i, (c, b, _, r) in enumerate(blocks):
            for c2, b2, _, r2 in blocks[i:]:
                if unit is not None and c != c2:
                    d = np.sqrt(max(0.0, 2 - 2 * float(unit[c] @ unit[c2])))
                    if d - r - r2 > limit + SLACK:
                        continue
                name = f"{k}|{c}.{b}|{c2}.{b2}"
                out.append((k, c, b, name, 0))
                if (c, b) != (c2, b2):
                    out.append((k, c2, b2, name, 1))
        return pd.DataFrame(out, columns=["key", "cell", "block", "pair", "side"])

    pairs = written(cells.groupBy("key").applyInPandas(meet, "key string, cell long, block long, pair string, side int"), "pairs")
    blocks = placed.join(cells.select("key", "cell", F.ceil(F.col("n") / cell).alias("blocks")), ["key", "cell"])
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("long")).select("uid", "key", "cell", "block", "embedding")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == k].sort_values("uid") for k in (0, 1)]
        columns = ["uid", "n", "root"]
        same = not len(sides[1])
        if not len(sides[0]) or (same and len(set(pdf["pair"].iloc[0].rsplit("|", 2)[1:])) > 1):
            return pd.DataFrame({c: [] for c in columns}, dtype="int64")
        s = CoverTree(_matrix(sides[0]["embedding"]))
        t = s if same else CoverTree(_matrix(sides[1]["embedding"]))
        cs, ct, i, j = dual_links(s, t, same, threshold)
        ids = sides[0]["uid"].to_numpy() if same else np.concatenate((sides[0]["uid"].to_numpy(), sides[1]["uid"].to_numpy()))
        n = cs if same else np.concatenate((cs, ct))
        root = ids[roots(len(ids), i, j if same else j + len(s.x))]
        some = n > 0
        return pd.DataFrame({"uid": ids[some], "n": n[some], "root": root[some]})

    found = blocks.join(pairs, ["key", "cell", "block"]).select("pair", "side", "uid", "embedding").groupBy("pair").applyInPandas(compare, "uid long, n long, root long")
    found = written(found, "links")
    comp = written(components(found, base.count(), "uid", "root"), "components")
    vec = base.select("uid", "vec_id")
    named = comp.join(vec.withColumnRenamed("uid", "id"), "id")
    least = written(named.groupBy("component_id").agg(F.min("vec_id").alias("least")), "least")
    ends = comp.join(least, "component_id").join(found.groupBy(F.col("uid").alias("id")).agg(F.sum("n").alias("n_links")), "id")
    out = vec.join(written(ends, "ends"), vec["uid"] == F.col("id"), "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

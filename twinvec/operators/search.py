"""Best-first graph search with exact re-ranking.

Two ways with the same answers on a connected graph: `search` ships an index of
checked size to tasks that walk it for their queries; `search_frames` keeps the index
in tables and moves all queries one hop a round by joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinvec.functions import intervals as R
from twinvec.functions import vector as V
from twinvec.operators import knn, metrics, pq
from twinvec.scratch import dropped, written

MODES = ("beam", "page", "rerank", "dap", "adaptive", "batched")
#: Bytes of vectors and edges that an index shipped to tasks may have.
MAX_INDEX = 1 << 29
BEAM, PAGE_NODES, DAP, TOGETHER = 4, 12, 1.5, 8


class Index:
    """Arrays of one index: ids, vectors, neighbours with ranges, entries, codes. An edge's ranges lie one after another."""

    codes = None

    def __init__(self, points: dict, edges: dict):
        """points: id, x, y; edges: src, pos, dst, n (ranges an edge), lo, hi (of all ranges): arrays in any order of rows."""
        order = np.argsort(points["id"], kind="stable")
        self.ids = points["id"][order]
        self.x, self.y = (points[c].reshape(len(order), -1)[order] for c in "xy")
        order = np.lexsort((edges["pos"], edges["src"]))
        self.near = np.searchsorted(self.ids, edges["dst"][order]).astype(np.int32)
        src = np.searchsorted(self.ids, edges["src"][order])
        self.at = np.searchsorted(src, np.arange(len(self.ids) + 1))
        n = edges["n"][order]
        ends = np.cumsum(n)
        take = np.repeat((np.cumsum(edges["n"]) - edges["n"])[order], n) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        self.lo, self.hi = edges["lo"][take], edges["hi"][take]
        self.slots = np.concatenate(([0], ends)).astype(np.int32)
        dx, dy = (np.sqrt(((m - m.mean(axis=0)) ** 2).sum(axis=1)) for m in (self.x, self.y))
        far, best = [], 0.0
        for i in np.lexsort((self.ids, -dx, -dy)).tolist():  # the far skyline
            if dx[i] > best:
                far.append(i)
                best = dx[i]
        self.entries = np.unique([int(np.argmin(dx)), int(np.argmin(dy)), *far])

    def neighbours(self, node: int, alpha: float, filtered: bool = True) -> np.ndarray:
        s = slice(self.at[node], self.at[node + 1])
        if not filtered:
            return self.near[s]
        ends = self.slots[s.start : s.stop + 1]
        r = slice(ends[0], ends[-1])
        # Of each edge the ranges that serve, counted by sums along all; one without ranges serves every weight.
        serving = np.concatenate(([0], np.cumsum((self.lo[r] <= alpha + 1e-9) & (alpha <= self.hi[r] + 1e-9))))[ends - ends[0]]
        return self.near[s][(np.diff(serving) > 0) | (np.diff(ends) == 0)]

    def places(self, ids) -> np.ndarray:
        """Where the ids lie that the index has."""
        ids = np.asarray([] if ids is None else ids, np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        return at[self.ids[at] == ids] if len(ids) else at

    def exact(self, nodes, qx, qy, alpha):
        dx, dy = np.sqrt(((self.x[nodes] - qx) ** 2).sum(axis=1)), np.sqrt(((self.y[nodes] - qy) ** 2).sum(axis=1))
        return alpha * dx + (1 - alpha) * dy, dx, dy


def walk(ix: Index, qx, qy, alpha: float, pool: int, mode: str = "beam", beam: int = BEAM, nav=None, trace: list | None = None, filtered: bool = True, seeds=()):
    """-> (distance, node) of the pool, nearest first. nav(nodes): the distance that
    steers, the exact one by default. seeds: nodes to begin from, besides the entries. adaptive: the
    beam begins at 1 and grows by one a round up to `beam`."""
    steer = nav or (lambda nodes: ix.exact(nodes, qx, qy, alpha)[0])
    entries = np.unique(np.concatenate((ix.entries, np.asarray(seeds, np.int64)))) if len(seeds) else ix.entries
    seen = set(entries.tolist())
    found = sorted(zip(steer(entries).tolist(), entries.tolist(), strict=True))[:pool]
    done: set[int] = set()
    pages: set[int] = set()
    waiting: list[int] = []
    best = [np.inf, np.inf]
    step = 0
    if trace is not None:
        trace += [(step, None, n) for _, n in found]
    while True:
        width = min(beam, step + 1) if mode == "adaptive" else beam
        front = waiting[:width] if waiting else [n for _, n in found if n not in done][:width]
        if not front:
            return found
        waiting = waiting[len(front) :]
        step += 1
        for node in front:
            if node in done:
                continue
            done.add(node)
            group = [node]
            if mode == "page" and node // PAGE_NODES not in pages:
                # What lies on the page that was read for the node is scored, too, and expanded in the next rounds.
                pages.add(node // PAGE_NODES)
                a = node // PAGE_NODES * PAGE_NODES
                rest = np.array([n for n in range(a, min(a + PAGE_NODES, len(ix.ids))) if n not in seen], dtype=np.int64)
                if len(rest):
                    seen.update(rest.tolist())
                    d = steer(rest)
                    found = sorted(set(found) | set(zip(d.tolist(), rest.tolist(), strict=True)))[:pool]
                    waiting += [n for _, n in sorted(zip(d.tolist(), rest.tolist(), strict=True))]
            for g in group:
                new = np.array([n for n in ix.neighbours(g, alpha, filtered).tolist() if n not in seen], dtype=np.int64)
                if not len(new):
                    continue
                seen.update(new.tolist())
                if mode == "dap":
                    # Near to the best seen in both spaces, or good enough by the fused distance.
                    fused, dx, dy = ix.exact(new, qx, qy, alpha)
                    early = (dx < DAP * best[0]) & (dy < DAP * best[1])
                    if early.any():
                        best = [min(best[0], dx[early].min()), min(best[1], dy[early].min())]
                    ok = early | (len(found) < pool) | (fused < found[-1][0])
                    new = new[ok]
                    if not len(new):
                        continue
                if trace is not None:
                    trace += [(step, g, n) for n in new.tolist()]
                found = sorted([*found, *zip(steer(new).tolist(), new.tolist(), strict=True)])[:pool]


def walk_together(ix: Index, queries: list, pool: int, beam: int = BEAM, filtered: bool = True) -> list:
    """walk() for some (qx, qy, alpha, seeds) at once: each round expands the fronts of all and scores
    what is new by one pass over the vectors."""
    qx, qy, alpha = np.stack([q[0] for q in queries]), np.stack([q[1] for q in queries]), np.array([q[2] for q in queries])
    new = {i: np.unique(np.concatenate((ix.entries, np.asarray(q[3], np.int64)))) for i, q in enumerate(queries)}
    seen, found, done = [set(new[i].tolist()) for i in new], [[] for _ in queries], [set() for _ in queries]
    while new:
        who = np.repeat(list(new), [len(v) for v in new.values()])
        node = np.concatenate(list(new.values()))
        d = alpha[who] * np.sqrt(((ix.x[node] - qx[who]) ** 2).sum(1)) + (1 - alpha[who]) * np.sqrt(((ix.y[node] - qy[who]) ** 2).sum(1))
        for i in new:
            mine = who == i
            found[i] = sorted([*found[i], *zip(d[mine].tolist(), node[mine].tolist(), strict=True)])[:pool]
        new = {}
        for i in range(len(queries)):
            front: list[int] = []
            while not front:
                front = [n for _, n in found[i] if n not in done[i]][:beam]
                if not front:
                    break
                done[i].update(front)
                near = {n for f in front for n in ix.neighbours(f, alpha[i], filtered).tolist()} - seen[i]
                if near:
                    seen[i] |= near
                    new[i] = np.array(sorted(near), dtype=np.int64)
                else:
                    front = []
    return found


#: Queries that walk_many moves at once, and bytes of its marks of what they have seen, at most.
MANY, MARKS = 256, 1 << 25


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, size of them, of each, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def walk_many(ix: Index, qx: np.ndarray, qy: np.ndarray, alpha: np.ndarray, seeds: list, pool: int, beam: int = BEAM, filtered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """walk() in mode beam for some queries, a row of qx and qy each: a round of all is a few passes over arrays.
    -> distances and places, a row a query, nearest first; infinite and -1 behind the last."""
    n, m = len(ix.ids), len(alpha)
    seen = np.zeros(m * n, bool)
    dist, node, done = np.full((m, pool), np.inf), np.full((m, pool), -1, np.int64), np.ones((m, pool), bool)
    who = np.repeat(np.arange(m), [len(ix.entries) + len(v) for v in seeds])
    key = np.unique(who * n + np.concatenate([np.zeros(0, np.int64), *(v for own in seeds for v in (ix.entries, own))]).astype(np.int64))
    while True:
        if len(key):
            seen[key] = True
            who, new = np.divmod(key, n)
            d = alpha[who] * np.sqrt(((ix.x[new] - qx[who]) ** 2).sum(axis=1)) + (1 - alpha[who]) * np.sqrt(((ix.y[new] - qy[who]) ** 2).sum(axis=1))
            near = d <= dist[who, -1]
            who, new, d = who[near], new[near], d[near]
            rows = np.unique(who)
            order = np.lexsort((np.concatenate((node[rows].ravel(), new)), np.concatenate((dist[rows].ravel(), d)), of := np.concatenate((np.repeat(rows, pool), who))))
            of = of[order]
            order = order[np.arange(len(of)) - np.searchsorted(of, of) < pool]
            for kept, more in ((node, new), (done, np.zeros(len(new), bool)), (dist, d)):
                kept[rows] = np.concatenate((kept[rows].ravel(), more))[order].reshape(-1, pool)
        i, j = np.nonzero(~done & (np.cumsum(~done, axis=1) <= beam))
        if not len(i):
            return dist, node
        done[i, j] = True
        at = ix.at[node[i, j]]
        size = ix.at[node[i, j] + 1] - at
        edge, who = _ragged(at, size), np.repeat(i, size)
        key = who * n + ix.near[edge]
        fresh = ~seen[key]
        edge, who, key = edge[fresh], who[fresh], key[fresh]
        if filtered and len(key):
            # As in Index.neighbours.
            size = (ix.slots[edge + 1] - ix.slots[edge]).astype(np.int64)
            r, a = _ragged(ix.slots[edge].astype(np.int64), size), np.repeat(alpha[who], size)
            serving = np.concatenate(([0], np.cumsum((ix.lo[r] <= a + 1e-9) & (a <= ix.hi[r] + 1e-9))))
            ends = np.cumsum(size)
            key = key[(serving[ends] > serving[ends - size]) | (size == 0)]
        key = np.unique(key)


def _bytes(points: DataFrame, edges: DataFrame) -> int:
    n, dims = points.agg(F.count("*"), F.coalesce(F.max(F.size("x") + F.size("y")), F.lit(0))).first()
    return n * dims * 8 + edges.count() * 64


def _flat(col, kind) -> np.ndarray:
    return np.asarray(col.flatten().cast(kind).to_numpy(zero_copy_only=False))


def _point_arrays(b) -> dict:
    import pyarrow as pa

    return {"id": b["id"].to_numpy(), "x": _flat(b["x"], pa.float64()), "y": _flat(b["y"], pa.float64())}


def _edge_arrays(b) -> dict:
    import pyarrow as pa

    r = b["ranges"].flatten()
    size = np.diff(np.asarray(b["ranges"].offsets)).astype(np.int64)
    return {"src": b["src"].to_numpy(), "pos": b["pos"].to_numpy(), "dst": b["dst"].to_numpy(), "n": size, **{c: _flat(pa.ListArray.from_arrays(pa.array([0, len(r)], pa.int32()), r.field(c)), pa.float64()) for c in ("lo", "hi")}}


def _packed(df: DataFrame, arrays) -> dict:
    """The arrays(batch) of all batches, one after another. Tasks turn rows into bytes, and two partitions at a time pass the driver, which
    holds no rows: as objects they would take many times an index's size."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if len(b):
                for name, v in arrays(b).items():
                    yield pa.RecordBatch.from_pydict({"name": [name], "kind": [v.dtype.str], "data": pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())})

    names = {"_point_arrays": {"id": "<i8", "x": "<f8", "y": "<f8"}, "_edge_arrays": {"src": "<i8", "pos": "<i8", "dst": "<i8", "n": "<i8", "lo": "<f8", "hi": "<f8"}}[arrays.__name__]
    found: dict[str, list] = {n: [] for n in names}
    for r in df.mapInArrow(run, "name string, kind string, data binary").toLocalIterator(prefetchPartitions=True):
        found[r.name].append(np.frombuffer(r.data, r.kind))
    return {n: np.concatenate(found.pop(n) or [np.zeros(0, kind)]) for n, kind in names.items()}


def shipped(points: DataFrame, edges: DataFrame, coded: bool = False):
    """The index of a graph, and it sent to all tasks; None where it is beyond MAX_INDEX bytes."""
    e = edges if edges.columns == ["src", "pos", "dst", "ranges"] else written(edges.select("src", "pos", "dst", "ranges"), "edges")
    if _bytes(points, e) > MAX_INDEX:
        return None
    ix = Index(_packed(points.select("id", "x", "y"), _point_arrays), _packed(e, _edge_arrays))
    ix.codes = _codes(ix) if coded else None
    return ix, points.sparkSession.sparkContext.broadcast(ix)


#: Rows that a search tries its pool on.
TRIED = 400


def enough(points: DataFrame, ask, k: int, pool: int, recall: float) -> int:
    """The least of pool and its half more, again and again, with which ask(queries, pool) finds `recall` percent of the exact answer:
    the mean over TRIED rows in hashed order, at the weights 0, 0.1 to 1, less twice its standard error. As near as the k-th counts as found."""
    q = points.select(F.col("id").alias("qid"), "x", "y", (F.pmod(F.xxhash64("id"), F.lit(11)) / 10).alias("alpha")).orderBy(F.xxhash64(F.lit(7), "qid"), "qid").limit(TRIED)
    q, n = written(q.coalesce(1), "tried"), points.count()
    truth = {r.qid: (r.n, r.far) for r in knn.exact_dual_knn(points, q, k).groupBy("qid").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()}
    while truth:
        got = dict.fromkeys(truth, 0)
        for r in ask(q, pool).select("qid", "dist").collect():
            got[r.qid] += r.dist <= truth[r.qid][1] * (1 + 1e-9)
        share = np.array([100 * min(1, got[i] / m) for i, (m, _) in truth.items()])
        if pool >= n or share.mean() - 2 * share.std() / np.sqrt(len(share)) >= recall:
            break
        pool = min(n, pool + -(-pool // 2))
    return pool


def search(points: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, pool: int = 64, mode: str = "beam", beam: int = BEAM,
           dead: DataFrame | None = None, truncate: float = 1e9, filtered: bool = True, seeds: DataFrame | None = None, recall: float | None = None, index=None) -> DataFrame:
    """queries (qid, x, y, alpha) -> qid, rank, id, dist. dead (id): found but not
    returned, so the pool bounds what is left of the k. rerank: codes steer, the best of the pool are scored exactly.
    batched: some queries move together. seeds (qid, id): where a query begins, besides the entries. An
    index beyond MAX_INDEX bytes is not shipped: all modes then search by joins. recall: in percent; a pool that finds less is
    widened (enough). index: shipped(points, edges), for several searches of one graph; with codes for rerank."""
    if pool < k:
        raise ValueError(f"a pool of {pool} for {k} results: the pool holds the results")
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: use one of {MODES}")
    if index is None:
        edges = written(edges.select("src", "pos", "dst", "ranges"), "edges")
        index = shipped(points, edges, mode == "rerank")
    if recall is not None:
        pool = enough(points, lambda q, wide: search(points, edges, q, k, wide, mode, beam, None, truncate, filtered, index=index), k, pool, recall)
    if index is None:
        return _by_joins(points, edges if filtered else edges.withColumn("ranges", R.none()), queries, k, pool, dead, seeds)
    shared = index[1]
    # The dead go by a join, whatever their number: a task returns its whole pool then.
    take = k if dead is None else pool

    def beamed(ix, pdf):
        """The rows of mode beam."""
        step = int(min(MANY, max(1, MARKS // max(len(ix.ids), 1))))
        for a in range(0, len(pdf), step):
            some = pdf.iloc[a : a + step]
            asked, qid = [knn._stack(some[c]) for c in "xy"], some["qid"].to_numpy()
            d, nodes = walk_many(ix, *asked, some["alpha"].to_numpy(np.float64), [ix.places(v) for v in some["seeds"]], pool, beam, filtered)
            i, j = np.nonzero((nodes >= 0) & (ix.ids[nodes] != qid[:, None]))
            rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
            i, j, rank = i[rank <= take], j[rank <= take], rank[rank <= take]
            yield pd.DataFrame({"row": some["row"].to_numpy()[i], "qid": qid[i], "rank": rank, "id": ix.ids[nodes[i, j]], "dist": d[i, j]})

    def run(batches):
        ix = shared.value
        tables = ix.codes if mode == "rerank" else None
        for pdf in batches:
            if mode == "beam" and len(ix.ids):
                yield from beamed(ix, pdf)
                continue
            out = []
            rows = list(pdf.itertuples())
            asked = [(np.asarray(r.x, np.float64), np.asarray(r.y, np.float64), r.alpha, ix.places(r.seeds)) for r in rows]
            together = [f for a in range(0, len(asked), TOGETHER) for f in walk_together(ix, asked[a : a + TOGETHER], pool, beam, filtered)] if mode == "batched" else None
            for at, (r, (qx, qy, alpha, start)) in enumerate(zip(rows, asked, strict=True)):
                if together is not None:
                    got = together[at]
                else:
                    got = walk(ix, qx, qy, alpha, pool, mode, beam, _adc(tables, qx, qy, alpha) if tables else None, filtered=filtered, seeds=start)
                nodes = np.array([n for _, n in got], dtype=np.int64)
                if mode == "rerank":
                    keep = len(nodes) if truncate >= len(nodes) else int(min(pool, len(nodes), max(truncate, np.ceil(truncate * (1 + np.log10(pool / truncate))))))
                    nodes = nodes[:keep]
                d = ix.exact(nodes, qx, qy, r.alpha)[0]
                best = [(float(v), int(ix.ids[n])) for v, n in sorted(zip(d.tolist(), nodes.tolist(), strict=True)) if int(ix.ids[n]) != r.qid]
                out += [(r.row, r.qid, i + 1, n, v) for i, (v, n) in enumerate(best[:take])]
            yield pd.DataFrame(out, columns=["row", "qid", "rank", "id", "dist"])

    q = queries.select("qid", "x", "y", "alpha")
    begin = seeds.groupBy("qid").agg(F.collect_set("id").alias("seeds")) if seeds is not None else None
    q = q.withColumn("seeds", F.array().cast("array<long>")) if begin is None else q.join(begin, "qid", "left")
    # A query is a row of `queries`: one id may ask with several weights.
    # Queries may lie in a single file, while their walks are work for all cores.
    found = q.withColumn("row", F.monotonically_increasing_id()).repartition(2 * q.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "row long, qid long, rank long, id long, dist double")
    if dead is not None:
        found = knn.top_k(found.drop("rank").join(dead.select("id").distinct(), "id", "left_anti"), k, partition="row")
    return found.select("qid", "rank", "id", "dist")


#: Rows that codebooks are trained on, at most.
TRAINED_ON = 16384
#: Rows that are encoded at a time.
CODED = 4096


def _codes(ix: Index, chunks: int = 8, codes: int = 64):
    out = []
    for m in (ix.x, ix.y):
        bounds = pq.chunk_bounds(m.shape[1], chunks)
        some = m if len(m) <= TRAINED_ON else m[np.random.default_rng(7).choice(len(m), TRAINED_ON, replace=False)]
        books = [pq.kmeans(some[:, a:b], codes, seed=a) for a, b in zip(bounds, bounds[1:], strict=False)]
        parts = [(a, b, book) for (a, b), book in zip(zip(bounds, bounds[1:], strict=False), books, strict=True)]
        # Differences of some rows at a time: of all they would take many times the index.
        code = np.concatenate([np.stack([((some_m[:, None, a:b] - book[None]) ** 2).sum(2).argmin(1) for a, b, book in parts], axis=1) for some_m in (m[r : r + CODED] for r in range(0, max(len(m), 1), CODED))])
        out.append((bounds, books, code))
    return out


def _adc(tables, qx, qy, alpha):
    sums = []
    for (bounds, books, code), q in zip(tables, (qx, qy), strict=True):
        sums.append((code, np.stack([((b - q[a:e]) ** 2).sum(1) for (a, e), b in zip(zip(bounds, bounds[1:], strict=False), books, strict=True)])))

    def nav(nodes):
        (cx, tx), (cy, ty) = sums
        at = np.arange(cx.shape[1])
        return alpha * np.sqrt(tx[at, cx[nodes]].sum(1)) + (1 - alpha) * np.sqrt(ty[at, cy[nodes]].sum(1))

    return nav


def trace(points: DataFrame, edges: DataFrame, queries: DataFrame, pool: int = 64) -> DataFrame:
    """qid, step, parent, id: who was found when, and from where."""
    index = shipped(points, edges)
    if index is None:
        raise ValueError(f"an index beyond {MAX_INDEX} bytes: use search_frames, or shard it")
    shared = index[1]

    def run(batches):
        ix = shared.value
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                t: list = []
                walk(ix, np.asarray(r.x, np.float64), np.asarray(r.y, np.float64), r.alpha, pool, trace=t)
                out += [(r.qid, s, None if p is None else int(ix.ids[p]), int(ix.ids[n])) for s, p, n in t]
            yield pd.DataFrame(out, columns=["qid", "step", "parent", "id"]).astype({"parent": "Int64"})

    q = queries.select("qid", "x", "y", "alpha").repartition(2 * queries.sparkSession.sparkContext.defaultParallelism)
    return q.mapInPandas(run, "qid long, step long, parent long, id long")


def _by_joins(points: DataFrame, edges: DataFrame, queries: DataFrame, k: int, pool: int, dead: DataFrame | None, seeds: DataFrame | None) -> DataFrame:
    q = written(queries.select(F.monotonically_increasing_id().alias("row"), "qid", "x", "y", "alpha"), "rows")
    begin = None if seeds is None else q.join(seeds.select("qid", "id").distinct(), "qid").select(F.col("row").alias("qid"), "id")
    got = search_frames(points, edges, q.select(F.col("row").alias("qid"), "x", "y", "alpha"), pool, pool, seeds=begin, exclude_self=False)
    got = got.select(F.col("qid").alias("row"), "id", "dist").join(q.select("row", "qid"), "row").where("qid <> id")
    if dead is not None:
        got = got.join(dead.select("id").distinct(), "id", "left_anti")
    return knn.top_k(got, k, partition="row").select("qid", "rank", "id", "dist")


#: Of a search by joins: rows and queries of a block, at most, and pairs that are scored at a time.
FRAME_ROWS, FRAME_QUERIES, FRAME_PAIRS = 1 << 14, 1 << 14, 1 << 14


def _met(left, right):
    """Scores one block's pairs. left: its rows and the queries (asked), with vectors; right: pairs (qid, id), each as often as it was
    reached. -> qid, id, dist: of each pair once, if it is defined and within the query's bar."""
    import pyarrow as pa

    asked = left["asked"].to_numpy()
    sides, at = [], []
    for side, ids in ((~asked, right["id"]), (asked, right["qid"])):
        t = left.filter(pa.array(side)).sort_by("key")
        sides.append((t["key"].to_numpy(), [knn._arrow_vectors(t[c]) for c in "xy"], t["alpha"].to_numpy(), t["bar"].to_numpy()))
        ids = ids.to_numpy()
        found = np.minimum(np.searchsorted(sides[-1][0], ids), max(len(t) - 1, 0))
        at.append(np.where(sides[-1][0][found] == ids, found, -1) if len(t) else np.full(len(ids), -1))
    (ids, rows, _, _), (qids, given, alpha, bar) = sides
    pair = np.unique((at[1] * len(ids) + at[0])[(at[0] >= 0) & (at[1] >= 0)])
    out: list = [[], [], []]
    with np.errstate(all="ignore"):
        for a in range(0, len(pair), FRAME_PAIRS):
            qi, i = np.divmod(pair[a : a + FRAME_PAIRS], len(ids))
            roots, known = [], np.ones(len(i), bool)
            for (m, size), (qm, qsize) in zip(rows, given, strict=True):
                n = min(m.shape[1], qm.shape[1])
                d = np.ascontiguousarray((qm[qi, :n] - m[i, :n]).T)
                # Summed in the order of the dimensions, as V.l2_sq does.
                roots.append(np.sqrt((d * d).sum(axis=0)))
                known &= (size[i] == qsize[qi]) & (size[i] >= 0)
            d = alpha[qi] * roots[0] + (1 - alpha[qi]) * roots[1]
            near = known & (d <= bar[qi])
            for o, v in zip(out, (qids[qi[near]], ids[i[near]], d[near]), strict=True):
                o.append(v)
    return pa.table({n: np.concatenate([np.zeros(0, kind), *v]) for n, kind, v in zip(("qid", "id", "dist"), (np.int64, np.int64, np.float64), out, strict=True)})


def search_frames(points: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, pool: int = 64, rounds: int = 1024, seeds: DataFrame | None = None, exclude_self: bool = True) -> DataFrame:
    """The same search as joins: the unexpanded rows of every query's pool meet the edges that serve its weight, what they lead to is
    scored by blocks, the pool's best stay. No table of seen rows is needed: what once fell out of a pool stays worse than all of it. Tables of
    a round go after the next."""
    spark = points.sparkSession
    p = written(points.select("id", "x", "y"), "points")
    e = written(edges.select("src", "dst", "ranges"), "edges")
    q = written(queries.select("qid", "x", "y", F.col("alpha").cast("double").alias("alpha")), "queries")
    from twinvec.operators.graph import centroids, to_centres
    from twinvec.operators.skyline import entry_points

    entries = entry_points(to_centres(p, centroids(p)).withColumnsRenamed({"dx2": "d1", "dy2": "d2"})).select("id")
    best = W.partitionBy("qid").orderBy("dist", "id")
    n = p.count()
    # Blocks for all cores where the rows are few.
    nb, nq = max(1, -(-n // FRAME_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // 1024))), max(1, -(-q.count() // FRAME_QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    none = F.lit(None).cast("double")
    nodes = p.select(block("id", nb).alias("rb"), every(nq).alias("qb"), F.lit(False).alias("asked"), F.col("id").alias("key"), "x", "y", none.alias("alpha"), none.alias("bar"))

    def scored(pairs: DataFrame, bars: DataFrame) -> DataFrame:
        """pairs (qid, id), bars (qid, bar): beyond which a distance is of no use."""
        asked = q.join(bars, "qid").select(every(nb).alias("rb"), block("qid", nq).alias("qb"), F.lit(True).alias("asked"), F.col("qid").alias("key"), "x", "y", "alpha", "bar")
        meet = pairs.select(block("id", nb).alias("rb"), block("qid", nq).alias("qb"), "qid", "id")
        return nodes.union(asked).groupBy("rb", "qb").cogroup(meet.groupBy("rb", "qb")).applyInArrow(_met, "qid long, id long, dist double")

    start = q.select("qid").crossJoin(F.broadcast(entries))
    start = start if seeds is None else start.union(seeds.select("qid", "id"))
    state = scored(start, q.select("qid", F.lit(float("inf")).alias("bar"))).withColumn("done", F.lit(False))
    state = written(state.withColumn("r", F.row_number().over(best)).where(F.col("r") <= pool).drop("r"), "pool")
    for _ in range(rounds):
        front = state.where(~F.col("done")).select("qid", F.col("id").alias("src"))
        if front.isEmpty():
            break
        hop = front.join(q.select("qid", "alpha"), "qid").join(e, "src")
        serves = (F.size("ranges") == 0) | F.exists("ranges", lambda r: (r.lo <= F.col("alpha") + 1e-9) & (F.col("alpha") <= r.hi + 1e-9))
        bars = state.groupBy("qid").agg(F.when(F.count("*") < pool, float("inf")).otherwise(F.max("dist")).alias("bar"), F.bool_and("done").alias("over")).where("not over").drop("over")
        new = scored(hop.where(serves).select("qid", F.col("dst").alias("id")), bars)
        grown = state.withColumn("done", F.lit(True)).unionByName(new.withColumn("done", F.lit(False)))
        # A row that was reached again has the same distance.
        grown = grown.repartition("qid").groupBy("qid", "id").agg(F.min("dist").alias("dist"), F.bool_or("done").alias("done"))
        old, state = state, written(grown.withColumn("r", F.row_number().over(best)).where(F.col("r") <= pool).drop("r"), "pool")
        dropped(old)
    return knn.top_k(state.where("qid <> id" if exclude_self else "true").select("qid", "id", "dist"), k).select("qid", "rank", "id", "dist")


def search_multigraph(points: DataFrame, queries: DataFrame, k: int = 10, budget: int = 20, degree: int = 16, pool: int = 64, method: str = "weighted") -> DataFrame:
    """Two one-space graphs share 2 * budget results by method (metrics.candidate_budget); the union
    is scored exactly."""
    from twinvec.operators.graph import build_single

    kx, ky = metrics.candidate_budget(method, F.col("alpha"), budget)
    parts = []
    for space, take, alpha in (("x", kx, 1.0), ("y", ky, 0.0)):
        g = build_single(points.select("id", F.col(space).alias("vec")), degree, pool).select("src", "pos", "dst", R.none().alias("ranges"))
        got = search(points, g, queries.withColumn("alpha", F.lit(alpha)), 2 * budget, pool)
        parts.append(got.join(queries.select("qid", take.alias("take")), "qid").where(F.col("rank") <= F.col("take")).select("qid", "id"))
    return knn.rerank(parts[0].union(parts[1]).distinct(), points, queries, k)


#: The weights that the specialised graphs are built for.
SPECIALISED = (0.1, 0.3, 0.5, 0.7, 0.9)


def search_specialised(points: DataFrame, queries: DataFrame, k: int = 10, degree: int = 16, pool: int = 64, weights: tuple[float, ...] = SPECIALISED) -> DataFrame:
    """One graph a weight; each query goes to the one built for the weight nearest to its own. With a
    single weight all queries share that graph."""
    from twinvec.operators.graph import build_fixed

    q = queries.withColumn("__route", metrics.nearest_weight(F.col("alpha"), weights))
    out = None
    for i, w in enumerate(weights):
        g = build_fixed(points, w, degree, pool).select("src", "pos", "dst", R.none().alias("ranges"))
        # Back-links keep what the choice at one weight leaves without in-neighbours within reach.
        back = g.select(F.col("dst").alias("src"), F.col("pos") + degree, F.col("src").alias("dst"), "ranges")
        got = search(points, g.union(back).dropDuplicates(["src", "dst"]), q.where(F.col("__route") == i), k, pool)
        out = got if out is None else out.union(got)
    return out


def sampled_entries(points: DataFrame, queries: DataFrame, share: float = 0.01, each: int = 4, seed: int = 42) -> DataFrame:
    """(qid, id): a query's nearest rows of a hashed sample, to begin a search from."""
    from twinvec.operators.shard import random_slice

    return knn.exact_dual_knn(random_slice(points, share, seed), queries, each).select("qid", "id").distinct()


def truth_window(truth: DataFrame, first: int, last: int, k: int, strict: bool = False) -> DataFrame:
    """Ground truth among ids first <= id < last, ranked anew. strict: fails if a
    query keeps fewer than k."""
    w = W.partitionBy("qid").orderBy("rank")
    out = truth.where((F.col("id") >= first) & (F.col("id") < last)).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    if strict:
        short = truth.select("qid").distinct().join(out.groupBy("qid").count(), "qid", "left").where(F.coalesce("count", F.lit(0)) < k)
        if not short.isEmpty():
            raise ValueError(f"fewer than {k} truth ids are left for some queries")
    return out

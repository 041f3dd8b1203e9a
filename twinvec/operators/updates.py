"""Changes to a graph: insertion by search, deletion with and without renumbering, workloads."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinvec.functions import vector as V
from twinvec.operators import graph, layout, search
from twinvec.scratch import written
from twinvec.sources.vecbin import _open

EDGES = ("src", "pos", "dst", "d1", "d2", "layer", "ranges")


def insert_rows(points: DataFrame, edges: DataFrame, new: DataFrame, degree: int = 32, pool: int = 64, passes: int = 2) -> DataFrame:
    """points (id, x, y) with their edges, and new rows -> edges of both. New rows search the graph for
    their candidates, at each of the building weights, are pruned, and link back; whoever got a link is
    pruned again. The second pass searches the grown graph, where new rows find each other."""
    every = written(points.select("id", "x", "y").union(new.select("id", "x", "y")), "rows")
    at, grown, shared = points, edges, graph.held(every)
    q = new.select(F.col("id").alias("qid"), "x", "y", F.explode(F.array(*[F.lit(a) for a in graph.ALPHAS])).alias("alpha"))
    for _ in range(passes):
        found = search.search(at, grown, q, pool, pool).select(F.col("qid").alias("src"), F.col("id").alias("dst"))
        own = grown.join(new.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
        first = written(graph.dual_edges(found.union(own), every, degree, shared=shared).select(*EDGES), "new-edges")
        back = first.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        met = back.select("src").distinct().join(new.select(F.col("id").alias("src")), "src", "left_anti")
        others = grown.join(new.select(F.col("id").alias("src")), "src", "left_anti")
        again = graph.dual_edges(others.join(met, "src", "left_semi").select("src", "dst").union(back), every, degree, shared=shared)
        # New rows keep what they chose and what links to them, pruned together.
        both = graph.dual_edges(first.select("src", "dst").union(back.join(new.select(F.col("id").alias("src")), "src", "left_semi")), every, degree, shared=shared)
        changed = again.join(met, "src", "left_semi").select(*EDGES).union(both.select(*EDGES))
        grown = written(others.join(met, "src", "left_anti").select(*EDGES).union(changed), "grown")
        at = every
    return grown


def build_by_search(points: DataFrame, degree: int = 32, pool: int = 64, first: int = 1000, seed: int = 42) -> DataFrame:
    """A graph whose candidates come from searches, not from comparing all rows: an exact graph over
    `first` rows in hashed order, which then doubles by batches. Work grows with the rows times a search."""
    return graph._over_firsts(points, ("x", "y"), lambda rows: _build_by_search(rows, degree, pool, first, seed))


def _build_by_search(points: DataFrame, degree: int, pool: int, first: int, seed: int) -> DataFrame:
    order = layout.assign_pages(points.select("id", F.xxhash64(F.lit(seed), "id").alias("key")), 1, "key").select("id", F.col("page_id").alias("at"))
    rows = written(points.select("id", "x", "y").join(order, "id"), "ordered")
    n, done = rows.count(), first
    edges = written(graph.build_dual(rows.where(F.col("at") < first).drop("at"), degree, pool).select(*EDGES), "seed-graph")
    while done < n:
        old, new = (rows.where((F.col("at") >= a) & (F.col("at") < b)).drop("at") for a, b in ((0, done), (done, 2 * done)))
        edges = insert_rows(old, edges, new, degree, pool)
        done *= 2
    return edges


def spliced(edges: DataFrame, dead: DataFrame, sampled: int) -> DataFrame:
    """Edges (src, pos, dst) of live sources, a dead neighbour replaced by its first `sampled` live ones -> src, dst."""
    gone = dead.select("id").distinct()
    w = W.partitionBy("src").orderBy("pos", "dst")
    live = edges.select("src", "pos", "dst").join(gone, F.col("dst") == gone["id"], "left_anti")
    lists = live.join(gone, F.col("src") == gone["id"], "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= sampled)
    kept = live.join(gone, F.col("src") == gone["id"], "left_anti").select("src", "dst")
    lost = edges.select("src", F.col("dst").alias("via")).join(gone, F.col("src") == gone["id"], "left_anti")
    through = lost.join(lists.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
    return kept.union(through).where("src <> dst").distinct()


def delete_in_place(edges: DataFrame, dead: DataFrame, degree: int, points: DataFrame, sampled: int = 10, alpha: float = 1.2) -> DataFrame:
    """(src, pos, dst), dead (id), points (id, vec) -> src, pos, dst under the same ids. Only sources that come to more
    than `degree` neighbours are pruned; the others keep all, in order of distance."""
    s = points.select(F.col("id").alias("src"), F.col("vec").alias("sv"))
    merged = written(spliced(edges, dead, sampled), "spliced")
    size = merged.groupBy("src").agg(F.count("*").alias("k"))
    over = size.where(F.col("k") > degree).select("src")
    pruned = graph._one_space(merged.join(over, "src", "left_semi"), points, degree, lambda ids, d, pair, r: graph.prune_slack(ids, d, pair, r, alpha)).select("src", "pos", "dst")
    few = merged.join(over, "src", "left_anti").join(s, "src").join(points.select(F.col("id").alias("dst"), "vec"), "dst")
    few = few.select("src", "dst", F.round(V.l2_sq(F.col("sv"), F.col("vec")), 9).alias("d"))
    few = few.withColumn("pos", F.row_number().over(W.partitionBy("src").orderBy("d", "dst")).cast("long"))
    return pruned.union(few.select("src", "pos", "dst"))


def merge_deletes(edges: DataFrame, dead: DataFrame, degree: int, points: DataFrame, sampled: int = 10, alpha: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """As delete_in_place, with dense new ids in order of the old ones -> edges under new ids, and (id, new_id), by which
    tags and codes follow."""
    ids = written(layout.remap_ids(points, dead), "ids")
    e = delete_in_place(edges, dead, degree, points, sampled, alpha)
    a, b = ids.select(F.col("id").alias("src"), F.col("new_id").alias("__s")), ids.select(F.col("id").alias("dst"), F.col("new_id").alias("__d"))
    return e.join(a, "src").join(b, "dst").select(F.col("__s").alias("src"), "pos", F.col("__d").alias("dst")), ids


def next_entry(edges: DataFrame, dead: DataFrame, entry: int) -> int | None:
    """The entry, or, if it is dead, its first live neighbour; None if it has none."""
    if dead.where(F.col("id") == entry).isEmpty():
        return entry
    live = edges.where(F.col("src") == entry).join(dead.select(F.col("id").alias("dst")), "dst", "left_anti")
    row = live.orderBy("pos", "dst").select("dst").first()
    return None if row is None else row[0]


# Workloads


def sliding_window(spark: SparkSession, first: int, last: int, size: int, steps: int) -> DataFrame:
    """seq, op, tag: each step deletes the `size` oldest tags from `first` on and inserts as many from `last` on."""
    s = spark.range(steps * size).select(F.floor(F.col("id") / size).cast("long").alias("step"), (F.col("id") % size).alias("i"))
    ops = s.select("step", "i", F.explode(F.array(F.lit("delete"), F.lit("insert"))).alias("op"))
    tag = F.when(F.col("op") == "delete", F.lit(first)).otherwise(F.lit(last)) + F.col("step") * size + F.col("i")
    turn = F.when(F.col("op") == "delete", 0).otherwise(size)
    return ops.select((F.col("step") * 2 * size + turn + F.col("i")).alias("seq"), "op", tag.cast("long").alias("tag"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A trace file, a count n, n tags to delete and n to insert -> seq, op, tag."""
    system, where = _open(path)
    with system.open_input_file(where) as f:
        raw = f.read()
    (n,) = struct.unpack_from("<i", raw)
    if n < 0 or len(raw) != 4 + 8 * n:
        raise ValueError(f"{path}: {len(raw)} bytes are no trace of {n} updates")
    tags = np.frombuffer(raw, "<u4", 2 * n, 4).astype(np.int64).tolist()
    return spark.createDataFrame([(i, "delete" if i < n else "insert", t) for i, t in enumerate(tags)], "seq long, op string, tag long")


def write_trace(path: str, deletes: list[int], inserts: list[int]) -> None:
    if len(deletes) != len(inserts):
        raise ValueError("a trace has as many deletions as insertions")
    system, where = _open(path)
    with system.open_output_stream(where) as f:
        f.write(struct.pack("<i", len(deletes)) + np.array([*deletes, *inserts], dtype="<u4").tobytes())

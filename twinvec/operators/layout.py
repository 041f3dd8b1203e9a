"""Record sizes, pages and orders of rows and dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinvec.scratch import written

PAGE = 8192
INVALID = 0xFFFFFFFF


def coord_bytes(dx: int, dy: int = 0, element: int = 4) -> int:
    return (dx + dy) * element


def topology_bytes(degree: int, slots: int) -> int:
    """A degree, and for each edge an id and two bytes a slot."""
    return 4 + degree * (4 + 2 * slots)


def records_per_page(size: int, page: int = PAGE) -> int:
    return page // size


def estimate_ram(points: int, dims: list[int], degree: int, element: int = 4, slack: float = 1.3, overhead: float = 1.1) -> float:
    """Bytes of a graph in memory: vectors, padded to 8 dimensions, and edges."""
    data = sum(points * (-(-d // 8) * 8) * element for d in dims)
    return overhead * (data + points * degree * 4 * slack)


#: Rows of a range of an order, and ranges at most.
RANGE_ROWS, MAX_RANGES = 100_000, 4096


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df with __p, the number of its row's range in the order. The cuts between ranges come from samples that
    differ by evaluation, so the ranges are written once where there are several."""
    parts = max(1, min(MAX_RANGES, -(-df.count() // RANGE_ROWS)))
    if parts == 1:
        return df.withColumn("__p", F.lit(0))
    return written(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranges")


def assign_pages(df: DataFrame, capacity: int, order: str = "id") -> DataFrame:
    """id -> page_id, slot, in order, `capacity` a page. Positions come from ranges of
    the order and their sizes, not from one window over all rows."""
    r = ranged(df.select("id", F.col(order).alias("__o")), "__o", "id")
    r = r.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy("__o", "id")) - 1)
    sizes = r.groupBy("__p").agg(F.count("*").alias("__n"))
    # One row a range, MAX_RANGES at most.
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    r = r.join(F.broadcast(before), "__p").withColumn("__i", F.col("__i") + F.col("__b"))
    at = F.col("__i").cast("long")
    return r.select("id", F.floor(at / capacity).cast("long").alias("page_id"), (at % capacity).cast("long").alias("slot"))


def greedy_pages(edges: DataFrame, capacity: int, max_edges: int = 20_000_000) -> DataFrame:
    """(src, dst) -> page_id, slot, id: fills a page with the node that has most links
    into it (linear deterministic greedy). One shard's graph: its size is checked."""
    n = edges.count()
    if n > max_edges:
        raise ValueError(f"{n} edges: shard the graph first, at most {max_edges} a call")

    def run(pdf):
        pdf = pdf.sort_values(["src", "dst"])
        src, dst = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
        nodes = np.unique(np.concatenate((src, dst)))
        out, left = [], dict.fromkeys(nodes.tolist())
        near: dict[int, list[int]] = {}
        for a, b in zip(src.tolist(), dst.tolist(), strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        page = 0
        while left:
            score: dict[int, int] = {}
            node = next(iter(left))
            for slot in range(capacity):
                out.append((page, slot, node))
                del left[node]
                score.pop(node, None)
                for o in near.get(node, ()):
                    if o in left:
                        score[o] = score.get(o, 0) + 1
                if not left:
                    break
                node = min(score, key=lambda o: (-score[o], o)) if score else next(iter(left))
            page += 1
        return pd.DataFrame(out, columns=["page_id", "slot", "id"])

    return edges.select(F.lit(0).alias("shard"), "src", "dst").groupBy("shard").applyInPandas(run, "page_id long, slot long, id long")


def ranked_pages(edges: DataFrame, capacity: int, max_edges: int = 20_000_000) -> DataFrame:
    """(src, dst, weight) -> page_id, slot, id: edges by falling weight bring their ends to one page where
    both together fit. Groups that stay smaller than a page are then filled up, largest first.
    One shard's graph: its size is checked."""
    n = edges.count()
    if n > max_edges:
        raise ValueError(f"{n} edges: shard the graph first, at most {max_edges} a call")

    def run(pdf):
        pdf = pdf.sort_values(["weight", "src", "dst"], ascending=[False, True, True])
        nodes = sorted({*pdf["src"].tolist(), *pdf["dst"].tolist()})
        group = {i: [i] for i in nodes}
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
            x, y = group[a], group[b]
            if x is not y and len(x) + len(y) <= capacity:
                x, y = (x, y) if len(x) >= len(y) else (y, x)
                x += y
                for i in y:
                    group[i] = x
        different = sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-len(g), g[0]))
        rooms: dict[int, list[list]] = {}
        pages: list[list] = []
        for g in different:
            room = next((r for r in range(len(g), capacity + 1) if rooms.get(r)), None)
            page = rooms[room].pop() if room else []
            if not room:
                pages.append(page)
            page += g
            rooms.setdefault(capacity - len(page), []).append(page)
        out = [(p, s, i) for p, page in enumerate(pages) for s, i in enumerate(page)]
        return pd.DataFrame(out, columns=["page_id", "slot", "id"])

    return edges.select(F.lit(0).alias("shard"), "src", "dst", "weight").groupBy("shard").applyInPandas(run, "page_id long, slot long, id long")


def pad_pages(pages: DataFrame, capacity: int) -> DataFrame:
    """page_id -> ids, padded with INVALID to the capacity."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("slot", "id"))), lambda r: r["id"].cast("long"))
    g = pages.groupBy("page_id").agg(ids.alias("ids"))
    return g.select("page_id", F.concat("ids", F.array_repeat(F.lit(INVALID).cast("long"), F.greatest(F.lit(0), capacity - F.size("ids")))).alias("ids"))


def page_reads(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(qid, id) -> pages read a query, each once."""
    return hits.join(pages.select("id", "page_id"), "id").groupBy("qid").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("nodes"))


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """The same order in every run: by a hash of seed and id."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id")


def dimension_order(dim: int, seed: int = 42) -> list[int]:
    return np.random.default_rng(seed).permutation(dim).tolist()


def random_rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A uniform orthogonal matrix: QR of a normal matrix with the signs of R's diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotate(df: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(id, vec) -> vectors times the matrix; distances stay."""
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf("array<double>")
    def turn(col: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack([np.asarray(v, np.float64) for v in col]) @ shared.value)) if len(col) else pd.Series([], dtype=object)

    return df.withColumn("vec", turn("vec"))


def remap_ids(df: DataFrame, dead: DataFrame) -> DataFrame:
    """(id) without the dead (id) -> id, new_id, dense in order of id."""
    alive = df.select("id").join(dead.select("id"), "id", "left_anti")
    return assign_pages(alive, 1).select("id", F.col("page_id").alias("new_id"))


def violations(pages: DataFrame, nodes: DataFrame, capacity: int) -> DataFrame:
    """Counts that are 0 for a sound layout: nodes without a place, nodes with two,
    places without a node, slots beyond the capacity."""
    missing = nodes.select("id").join(pages, "id", "left_anti").agg(F.count("*").alias("missing"))
    twice = pages.groupBy("id").count().where("count > 1").agg(F.count("*").alias("twice"))
    strange = pages.join(nodes.select("id"), "id", "left_anti").agg(F.count("*").alias("strange"))
    beyond = pages.where(F.col("slot") >= capacity).agg(F.count("*").alias("beyond"))
    return missing.crossJoin(twice).crossJoin(strange).crossJoin(beyond)

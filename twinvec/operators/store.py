"""An index as tables: coordinates, topology, ranges, tags and one row of metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinvec.functions import intervals as R
from twinvec.operators import layout

#: Which columns lie together, T the topology, X and Y the spaces: fixed names of the layouts.
LAYOUTS = {
    "S_TX": ("TX",), "S_T_X": ("T", "X"), "S_TD": ("TXY",), "S_T_D": ("T", "XY"),
    "TXY": ("TXY",), "TX_Y": ("TX", "Y"), "TY_X": ("TY", "X"), "T_XY": ("T", "XY"), "T_X_Y": ("T", "X", "Y"),
}
HUNDREDTHS = "array<struct<lo:tinyint,hi:tinyint>>"


@dataclass
class Stored:
    """points (id, x, y), edges (src, pos, dst, ranges), tags (id, tag), and meta."""

    meta: dict
    points: DataFrame
    edges: DataFrame
    tags: DataFrame


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, pos, dst, ranges) -> id, degree, neighbours: one record a node, ranges in hundredths."""
    n = F.array_sort(F.collect_list(F.struct("pos", "dst", R.quantize(F.col("ranges")).alias("ranges"))))
    return edges.groupBy(F.col("src").alias("id")).agg(n.alias("neighbours")).select("id", F.size("neighbours").alias("degree"), "neighbours")


def edges_of(records: DataFrame) -> DataFrame:
    """The edges of adjacency records; hundredths become weights again."""
    e = records.select(F.col("id").alias("src"), F.explode("neighbours").alias("n"))
    return e.select("src", "n.pos", "n.dst", F.transform("n.ranges", lambda r: R.span(r.lo / 100.0, r.hi / 100.0)).alias("ranges"))


def _columns(group: str) -> list[str]:
    return [c for part, cs in (("T", ["degree", "neighbours"]), ("X", ["x"]), ("Y", ["y"])) if part in group for c in cs]


def save(folder: str, points: DataFrame, edges: DataFrame, tags: DataFrame | None = None, kind: str = "T_XY", degree: int = 32, slots: int = 2, pages: int = 64) -> None:
    """One table a group of columns, dealt by ranges of ids, so that a reader of few ids opens
    few files. Nodes without edges keep an empty record. tags: ids name themselves by default."""
    nodes = points.select("id", "x", "y").join(adjacency(edges), "id", "left")
    nodes = nodes.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("neighbours", F.coalesce("neighbours", F.array().cast(nodes.schema["neighbours"].dataType)))
    for group in LAYOUTS[kind]:
        nodes.select("id", *_columns(group)).repartitionByRange(pages, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/{group}")
    t = tags if tags is not None else points.select("id", F.col("id").alias("tag"))
    t.select("id", "tag").write.mode("overwrite").parquet(f"{folder}/tags")
    head = points.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dx"), F.max(F.size("y")).alias("dy"))
    head.select("*", F.lit(degree).alias("degree"), F.lit(slots).alias("slots"), F.lit(kind).alias("layout")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def load(spark: SparkSession, folder: str, sidecar: DataFrame | None = None) -> Stored:
    """The tables of a folder, whatever their layout. sidecar (src, pos, ranges): ranges kept apart."""
    meta = spark.read.parquet(f"{folder}/meta").first().asDict()
    groups = {g: spark.read.parquet(f"{folder}/{g}") for g in LAYOUTS[meta["layout"]]}

    def holding(part: str) -> DataFrame:
        return next(df for g, df in groups.items() if part in g)

    points = holding("X").select("id", "x")
    points = holding("X").select("id", "x", "y") if holding("X") is holding("Y") else points.join(holding("Y").select("id", "y"), "id")
    edges = edges_of(holding("T").select("id", "neighbours"))
    return Stored(meta, points, with_sidecar(edges, sidecar) if sidecar is not None else edges, spark.read.parquet(f"{folder}/tags"))


def split(spark: SparkSession, folder: str, target: str, kind: str = "T_XY") -> None:
    """The same index in another layout."""
    s = load(spark, folder)
    save(target, s.points, s.edges, s.tags, kind, s.meta["degree"], s.meta["slots"])


def copy(spark: SparkSession, folder: str, target: str) -> None:
    s = load(spark, folder)
    save(target, s.points, s.edges, s.tags, s.meta["layout"], s.meta["degree"], s.meta["slots"])


# Ranges in a sidecar


def sidecar(edges: DataFrame) -> DataFrame:
    """src, pos, ranges in hundredths."""
    return edges.select("src", "pos", R.quantize(F.col("ranges")).alias("ranges"))


def with_sidecar(edges: DataFrame, ranges: DataFrame) -> DataFrame:
    """Edges with the ranges (weights) of the sidecar; an edge that it lacks serves all weights."""
    r = ranges.select("src", "pos", F.transform("ranges", lambda r: R.span(r.lo / 100.0, r.hi / 100.0)).alias("ranges"))
    return edges.drop("ranges").join(r, ["src", "pos"], "left").withColumn("ranges", F.coalesce("ranges", R.none()))


def sidecar_active(ranges: Column, alpha: Column) -> Column:
    """Whether an edge serves a weight by its sidecar row, in hundredths: no row (null) serves
    all; a row serves what its ranges hold, read up to a (0, 0) slot or one that begins beyond the weight."""
    a = F.round(alpha * 100, 6)
    stop = F.transform(ranges, lambda r, i: F.when(((r.lo == 0) & (r.hi == 0)) | (r.lo > a), i))
    n = F.coalesce(F.array_min(F.filter(stop, lambda i: i.isNotNull())), F.size(ranges))
    return ranges.isNull() | F.exists(F.slice(ranges, F.lit(1), n), lambda r: (r.lo <= a) & (a <= r.hi))


# Tags


def by_id(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("id").distinct(), "id", "left_semi")


def by_tag(points: DataFrame, tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tag) -> tag, id and the row."""
    return tags.join(wanted.select("tag").distinct(), "tag", "left_semi").join(points, "id")


def active_tags(tags: DataFrame, dead: DataFrame) -> DataFrame:
    return tags.select("tag").distinct().join(dead.select("tag"), "tag", "left_anti")


def to_global(edges: DataFrame, idmap: DataFrame) -> DataFrame:
    """Edges (src, pos, dst) of a shard's own ids -> ids of the whole table. idmap (local, id)."""
    a, b = idmap.select(F.col("local").alias("src"), F.col("id").alias("__s")), idmap.select(F.col("local").alias("dst"), F.col("id").alias("__d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("__s").alias("src"), "pos", F.col("__d").alias("dst"))


# Records and pages


def group_bytes(group: str, dx: int, dy: int, degree: int, slots: int, element: int = 4) -> int:
    return ("T" in group) * layout.topology_bytes(degree, slots) + ("X" in group) * dx * element + ("Y" in group) * dy * element


def page_reads(hits: DataFrame, kind: str, dx: int, dy: int, degree: int, slots: int, page: int = layout.PAGE) -> DataFrame:
    """hits (qid, part, at), part T, X or Y of the record in place `at` -> qid, pages read, each once. Records
    larger than a page take whole pages."""
    out = None
    for number, group in enumerate(LAYOUTS[kind]):
        size = group_bytes(group, dx, dy, degree, slots)
        per, each = max(1, page // size), -(-size // page)
        h = hits.where(F.col("part").isin(*group)).select("qid", F.lit(number).alias("g"), F.floor(F.col("at") / per).alias("p"), F.lit(each).alias("each")).distinct()
        out = h if out is None else out.union(h)
    return out.groupBy("qid").agg(F.sum("each").cast("long").alias("pages"))


def reorder(df: DataFrame, order: DataFrame, capacity: int) -> DataFrame:
    """(id) and order (id, at) -> id, page_id, slot in the new places."""
    at = F.col("at").cast("long")
    return df.select("id").join(order.select("id", "at"), "id").select("id", F.floor(at / capacity).cast("long").alias("page_id"), (at % capacity).alias("slot"))


# Soundness


def edge_violations(edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """Counts that are 0 for sound edges (src, pos, dst): loops, repeats, ends that are no
    nodes, positions with gaps, sources with more than `degree` edges."""
    n = nodes.select("id").distinct()
    a = edges.agg(F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"))
    b = edges.groupBy("src", "dst").count().where("count > 1").agg(F.count("*").alias("repeats"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    c = ends.join(n, "id", "left_anti").agg(F.count("*").alias("unknown"))
    per = edges.groupBy("src").agg(F.count("*").alias("k"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    d = per.agg(F.count(F.when((F.col("first") != 1) | (F.col("last") != F.col("k")), 1)).alias("gaps"), F.count(F.when(F.col("k") > degree, 1)).alias("beyond"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)


def range_violations(edges: DataFrame) -> DataFrame:
    """(ranges as weights, slots as stored hundredths) -> counts that are 0 for sound ranges: ends out of
    0..100 or in wrong order, slots not in order, slots used after a (0, 0), ranges that no slot covers."""
    used = F.filter("slots", lambda s: ~((s.lo == 0) & (s.hi == 0)))
    wrong = F.exists(used, lambda s: (s.lo > s.hi) | (s.lo < 0) | (s.hi > 100))
    front = F.slice(F.col("slots"), F.lit(1), F.size(used))
    after = F.exists(front, lambda s: (s.lo == 0) & (s.hi == 0))
    narrowed = F.exists("ranges", lambda r: ~F.exists(used, lambda s: (s.lo / 100.0 <= r.lo + 1e-9) & (s.hi / 100.0 >= r.hi - 1e-9)))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return edges.agg(count(wrong, "wrong"), count(F.array_sort(used) != used, "unsorted"), count(after, "after_end"), count(narrowed, "narrowed"))

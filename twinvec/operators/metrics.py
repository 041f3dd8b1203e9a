"""Recall, work statistics and curve operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinvec.operators import layout


def recall_at_k(result: DataFrame, truth: DataFrame, k: int, active: DataFrame | None = None) -> DataFrame:
    """result (qid, id), truth (qid, rank, id, dist) -> qid, hits, recall. Truth is
    extended by all ids as far as the k-th; with `active` (id), ranks count active
    ids only. Repeated results count once."""
    if active is not None:
        truth = truth.join(active.select("id").distinct(), "id", "left_semi")
        w = W.partitionBy("qid").orderBy("rank")
        truth = truth.withColumn("rank", F.row_number().over(w).cast("long"))
    kth = truth.where(F.col("rank") == k).select("qid", F.col("dist").alias("__kth"))
    gold = truth.join(kth, "qid", "left").where((F.col("rank") <= k) | (F.col("dist") <= F.col("__kth"))).select("qid", "id")
    hits = gold.join(result.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    every = truth.select("qid").distinct().join(hits, "qid", "left")
    n = F.least(F.coalesce("hits", F.lit(0)), F.lit(k)).cast("long")
    return every.select("qid", n.alias("hits"), (n * 100.0 / k).alias("recall"))


def percentile_floor(df: DataFrame, value: str, p: float) -> DataFrame:
    """sorted[floor(p * n)], without interpolation. Only the range that holds it is sorted."""
    v = layout.ranged(df.where(F.col(value).isNotNull()).select(value), value)
    sizes = sorted(v.groupBy("__p").count().collect())  # one row a range
    n = sum(c for _, c in sizes)
    at, here = min(int(p * n), max(n - 1, 0)), 0
    for here, c in sizes:
        if at < c:
            break
        at -= c
    return v.where(F.col("__p") == here).select(value).orderBy(value).limit(at + 1).agg(F.max(value).alias("value"))


def summary(df: DataFrame, value: Column) -> DataFrame:
    """mean, median, p10, p90 and how many values are defined."""
    v = df.select(value.alias("v"))
    return v.agg(
        F.count("v").alias("valid"), F.sum(F.col("v").isNull().cast("long")).alias("undefined"), F.avg("v").alias("mean"),
        F.percentile("v", F.lit(0.1)).alias("p10"), F.percentile("v", F.lit(0.5)).alias("median"), F.percentile("v", F.lit(0.9)).alias("p90"),
    )


#: Bits of a value that one pass of ordered() tells apart, and values that it gathers at the end, at most.
PASS_BITS, GATHERED = 18, 1 << 17


def ordered(values, ranks) -> tuple[dict[int, float], int, int, float]:
    """The values of exact ranks without an order of them: values(emit, schema, done) runs emit(array, state) over all values, which are
    not negative and may be NaN. Passes count values by more and more of their bits, which order them, in tables of
    2^PASS_BITS numbers a task. ranks(n): the wanted ones of n -> {rank: value}, n, how many are NaN, and the sum."""

    def keys(v):
        return (v + 0.0).view(np.int64)

    def counted(ranges):
        def emit(v, state):
            state["nan"] = state.get("nan", 0) + int(np.isnan(v).sum())
            v = v[~np.isnan(v)]
            state["sum"] = state.get("sum", 0.0) + float(v.sum())
            k = keys(v)
            for lo, shift in ranges:
                at = (k - lo) >> shift
                n = np.bincount(at[(at >= 0) & (at < 1 << PASS_BITS)], minlength=1 << PASS_BITS)
                state[lo, shift] = state[lo, shift] + n if (lo, shift) in state else n

        def done(state):
            rows = [(-1, 0, 0, state["nan"], state["sum"])]
            for lo, shift in ranges:
                rows += [(lo, shift, int(b), int(state[lo, shift][b]), 0.0) for b in np.nonzero(state[lo, shift])[0].tolist()]
            return dict(zip(("lo", "shift", "bin", "n", "total"), map(list, zip(*rows, strict=True)), strict=True))

        df = values(emit, "lo long, shift long, bin long, n long, total double", done)
        return df.groupBy("lo", "shift", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()

    whole = (0, 63 - PASS_BITS)
    got = counted([whole])
    nan, total = next(((r.n, r.total) for r in got if r.lo < 0), (0, 0.0))
    n = sum(r.n for r in got if r.lo >= 0)
    #: rank -> the range of keys that holds it and how many values are before the range.
    at = {r: (*whole, 0) for r in ranks(n)} if n else {}
    out: dict[int, float] = {}
    while at:
        bins: dict = {}
        for r in sorted(got, key=lambda r: r.bin):
            bins.setdefault((r.lo, r.shift), []).append((r.bin, r.n))
        held = {}
        for rank, (lo, shift, before) in list(at.items()):
            for b, c in bins[lo, shift]:
                if rank < before + c:
                    break
                before += c
            start = lo + (b << shift)
            if shift == 0:
                out[rank] = float(np.array(start, np.int64).view(np.float64))
                del at[rank]
            else:
                less = max(0, shift - PASS_BITS)
                at[rank], held[start, shift] = (start, less, before), c
        if held and sum(held.values()) <= GATHERED:
            def emit(v, state, ranges=tuple(held)):
                k = keys(v[~np.isnan(v)])
                for lo, shift in ranges:
                    state.setdefault("found", []).append(k[(k >= lo) & (k - lo < 1 << shift)])

            rows = values(emit, "key long", lambda state: {"key": np.concatenate(state["found"])}).toArrow()["key"].to_numpy()
            for rank, (lo, _, before) in at.items():
                shift = next(s for a, s in held if a == lo)
                mine = np.sort(rows[(rows >= lo) & (rows - lo < 1 << shift)])
                out[rank] = float(mine[rank - before : rank - before + 1].view(np.float64)[0])
            break
        if at:
            got = counted(sorted({(lo, shift) for lo, shift, _ in at.values()}))
    return out, n, nan, total


def matched_recall(points: DataFrame, targets: list[float], series: str = "series", recall: str = "recall", cost: str = "cost", order: str = "budget") -> DataFrame:
    """Cost at each target recall: of the first point that has it exactly, else by linear
    interpolation between the first neighbouring budgets that bracket it upwards;
    nothing outside the measured points."""
    w = W.partitionBy(series).orderBy(order)
    p = points.withColumn("__r", F.lead(recall).over(w)).withColumn("__c", F.lead(cost).over(w))
    p = p.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    equal = F.col(recall) == F.col("target")
    between = (F.col(recall) < F.col("target")) & (F.col("target") < F.col("__r"))
    share = F.when(equal, 0.0).otherwise((F.col("target") - F.col(recall)) / (F.col("__r") - F.col(recall)))
    value = F.when(equal, F.col(cost)).otherwise(F.col(cost) + share * (F.col("__c") - F.col(cost)))
    hit = p.where(equal | between).select(series, "target", F.struct((~equal).alias("after"), F.col(order), value.alias("v")).alias("s"))
    return hit.groupBy(series, "target").agg(F.min("s").alias("s")).select(series, "target", F.col("s.v").alias("cost"))


def work_frontier(points: DataFrame, targets: list[float], series: str = "series", recall: str = "recall", cost: str = "cost", ties: tuple[str, ...] = ()) -> DataFrame:
    """The cheapest measured point that reaches each target -> series, target, cost and
    the columns `ties`, which decide in their order between points of equal cost."""
    p = points.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets]))).where(F.col(recall) >= F.col("target"))
    best = p.groupBy(series, "target").agg(F.min(F.struct(F.col(cost).alias("cost"), *ties)).alias("m"))
    return best.select(series, "target", "m.*")


def budget_split(alpha: Column, total: int, end: float = 0.05) -> tuple[Column, Column]:
    """(kx, ky) of 2 * total between two one-space indexes; the weight's ends use one."""
    kx = F.floor(alpha * 2 * total + 0.5).cast("long")
    kx = F.when(alpha <= end, F.lit(0)).when(alpha >= 1 - end, F.lit(2 * total)).otherwise(F.least(F.lit(2 * total - 1), F.greatest(F.lit(1), kx)))
    return kx.cast("long"), (F.lit(2 * total) - kx).cast("long")


def candidate_budget(method: str, alpha: Column, each: int, end: float = 0.05) -> tuple[Column, Column]:
    """(kx, ky) by method: equal shares; weighted; or equal shares but all for one index at the weight's ends."""
    if method == "weighted":
        return budget_split(alpha, each, end)
    if method not in ("equal", "endpoint"):
        raise ValueError(f"method {method!r}: use equal, weighted or endpoint")
    kx = F.lit(each)
    if method == "endpoint":
        kx = F.when(alpha <= end, 0).when(alpha >= 1 - end, 2 * each).otherwise(each)
    return kx.cast("long"), (F.lit(2 * each) - kx).cast("long")


def nearest_weight(alpha: Column, weights: tuple[float, ...]) -> Column:
    """The index of the nearest of some weights; the first of equally near ones."""
    return F.array_min(F.array(*[F.struct(F.round(F.abs(alpha - w), 6).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights)]))["i"]


def valid_pools(pools: list[int], k: int) -> list[int]:
    """Pools that can hold k results, in their order."""
    return [p for p in pools if p >= k]


def latency_summary(stats: DataFrame, run: str, micros: str, means: tuple[str, ...] = (), shares: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999), threads: int = 1) -> DataFrame:
    """One row a query -> per run: queries, their rate at so many threads, mean latency, sorted[floor(share * n)] for
    each share, and the means of other columns. Latencies are counted by value first, so a run's order
    is one over different values."""
    s = stats.where(F.col(micros).isNotNull())
    total = s.groupBy(run).agg(F.count("*").alias("queries"), (F.count("*") * 1e6 * threads / F.sum(micros)).alias("qps"), F.avg(micros).alias("mean"), *[F.avg(m).alias(f"mean_{m}") for m in means])
    w = W.partitionBy(run).orderBy(micros)
    c = s.groupBy(run, micros).agg(F.count("*").alias("__n")).withColumn("__to", F.sum("__n").over(w)).join(total.select(run, F.col("queries").alias("__all")), run)
    cut = [F.min(F.when(F.col("__to") > F.floor(F.lit(p) * F.col("__all")), F.col(micros))).alias(f"p{p * 100:g}".replace(".", "_")) for p in shares]
    return total.join(c.groupBy(run).agg(*cut), run)


def interval_statistics(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """edges (key, slots: ranges in hundredths), weights (percent, n: queries at it) -> one row: edges, used slots, mean
    width, pairs of slots that overlap and edges with such, mean queries an edge serves (each once)."""
    used = F.filter("slots", lambda s: ~((s.lo == 0) & (s.hi == 0)) & (s.lo >= 0) & (s.hi >= s.lo) & (s.hi <= 100))
    e = edges.select("key", used.alias("u"))
    earlier = F.transform("u", lambda s, i: F.size(F.filter(F.slice(F.col("u"), F.lit(1), i), lambda r: s.lo <= r.hi)))
    e = e.withColumn("pairs", F.aggregate(earlier, F.lit(0), lambda a, b: a + b))
    served = F.array_distinct(F.flatten(F.transform("u", lambda s: F.sequence(s.lo.cast("int"), s.hi.cast("int")))))
    # One number a percent, 101 at most.
    per = F.broadcast(weights.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("percent").cast("int"), F.col("n").cast("long")))).alias("h")))
    e = e.withColumn("served", served).crossJoin(per)
    total = F.aggregate(F.transform("served", lambda p: F.coalesce(F.col("h")[p], F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    widths = F.aggregate("u", F.lit(0), lambda a, s: a + (s.hi - s.lo).cast("int"))
    return e.agg(
        F.count("*").alias("edges"), F.sum(F.size("u")).alias("slots"), (F.sum(widths) / F.sum(F.size("u"))).alias("mean_width"), F.sum("pairs").alias("overlaps"),
        F.count(F.when(F.col("pairs") > 0, 1)).alias("overlapping"), F.avg(total).alias("mean_served"),
    )


def first_discoveries(expanded: DataFrame, edges: DataFrame, weights: DataFrame, entries: DataFrame, truth: DataFrame) -> DataFrame:
    """expanded (qid, step, src): what a search without a filter expanded, in order; edges (src, pos, dst, slots); weights
    (qid, alpha); entries (id); truth (qid, id) -> per query: edges scanned and how many do not serve its weight, nodes found
    first through an edge and through one that does not serve, true hits found through such."""
    from twinvec.functions import intervals as R

    e = expanded.join(weights, "qid").join(edges, "src").withColumn("blocked", ~R.active(F.col("slots"), F.col("alpha")))
    scanned = e.groupBy("qid").agg(F.count("*").alias("scanned"), F.sum(F.col("blocked").cast("long")).alias("inactive"))
    first = e.groupBy("qid", F.col("dst").alias("id")).agg(F.min_by("blocked", F.struct("step", "pos")).alias("blocked")).join(entries.select("id").distinct(), "id", "left_anti")
    hit = truth.select("qid", "id", F.lit(True).alias("true"))
    found = first.join(hit, ["qid", "id"], "left").groupBy("qid").agg(
        F.count("*").alias("found"), F.sum(F.col("blocked").cast("long")).alias("found_inactive"), F.count(F.when(F.col("blocked") & F.col("true"), 1)).alias("hits_inactive")
    )
    return scanned.join(found, "qid", "left").na.fill(0)


def visit_counts(trace: DataFrame) -> DataFrame:
    return trace.groupBy("id").agg(F.count("*").alias("visits"))


def discovery_counts(trace: DataFrame) -> DataFrame:
    """trace (qid, step, parent, id): how often each parent was first to find a child."""
    first = trace.where("parent is not null").groupBy("qid", "id").agg(F.min_by("parent", F.struct("step", "parent")).alias("parent"))
    return first.groupBy("parent", "id").agg(F.count("*").alias("freq"))


def coverage(x_top: DataFrame, y_top: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, union size, and truth ids that the x, the y and both lists cover."""
    x, y = x_top.select("qid", "id").distinct(), y_top.select("qid", "id").distinct()
    both = x.withColumn("in_x", F.lit(1)).join(y.withColumn("in_y", F.lit(1)), ["qid", "id"], "full")
    size = both.groupBy("qid").agg(F.count("*").alias("union_size"))
    t = truth.select("qid", "id").join(both, ["qid", "id"], "left")
    cov = t.groupBy("qid").agg(F.count("in_x").alias("by_x"), F.count("in_y").alias("by_y"), F.sum((F.col("in_x").isNotNull() | F.col("in_y").isNotNull()).cast("long")).alias("by_union"))
    return cov.join(size, "qid")

"""What the operators share: words, prefix sums, components, joins by key groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinvec.scratch import dropped, few, written

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, f) -> Column:
    """f(value), value computed once however often f names it, also inside the
    lambdas of other array functions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def prefix_fold(values: Column, op, zero: int = 0, block: int = 128) -> Column:
    """array<int> -> array<int> of the fold by op of the elements before each. Blocks keep the
    work near k * block for k elements, where one fold with appends takes k * k."""
    total = lambda a: F.aggregate(a, F.lit(zero), op)
    of = lambda i: F.floor(i / block).cast("int")

    def over(a: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), of(F.size(a) - 1)))
        sums = F.transform(blocks, lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
        before = let(sums, lambda t: F.transform(t, lambda _, j: total(F.slice(t, F.lit(1), j))))
        return let(before, lambda p: F.transform(a, lambda _, i: op(F.get(p, of(i)), total(F.slice(a, of(i) * block + 1, i % block)))))

    return let(values, over)


def prefix_sums(lens: Column) -> Column:
    return prefix_fold(lens, lambda s, x: s + x)


#: Links that a task holds while it contracts them.
HELD = 1_000_000


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that links reach, of each of n."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        live = a != b
        if not live.any():
            return root
        i, j = i[live], j[live]
        np.minimum.at(root, np.maximum(a, b)[live], np.minimum(a, b)[live])
        while ((above := root[root]) != root).any():
            root = above


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v) -> fewer edges of the same components: each task links what its own
    rows connect to the least id among it, HELD rows at a time."""

    def star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = roots(len(ids), at[: len(u)], at[len(u) :])
        some = root != np.arange(len(ids))
        return ids[some], ids[root[some]]

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            size += len(held[-1][0])
            if size >= HELD:
                u, v = star(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [(u, v)], len(u)
                if size >= HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    held, size = [], 0
        if size:
            u, v = star(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def stars(links: DataFrame, rows: int, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between up to `rows` ids -> a written table (u, v): each id of a component, but the least,
    with the least. Self-links and repeats are ignored.

    Links are gathered in few tasks, which contract what they hold (not where links come up: that
    would keep two Python workers a task). If it is one task that could hold all, stars are left; else
    large-star and small-star rounds
    alternate until all edges form stars: every round is a few shuffles on ids,
    whatever the size of a component; its state is a written table.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    tasks = -(-max(1, rows) // (4 * HELD))
    edges = written(contracted(edges.repartition(tasks)), "edges")
    if tasks == 1 and edges.count() < HELD // 2:  # a task that holds more sends some on early
        return edges
    files = few(rows)
    for _ in range(max_rounds):
        # Stars: every end has one centre, and no centre is an end.
        none = F.lit(None).cast("long")
        sides = edges.select(F.col("u").alias("n"), "v", F.lit(0).alias("centre")).union(edges.select(F.col("v").alias("n"), none, F.lit(1)))
        state = sides.groupBy("n").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("centre").alias("centre"))
        if state.where("lo <> hi or (lo is not null and centre = 1)").isEmpty():
            return edges
        # Large star: each node's larger neighbours go to its smallest neighbour.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.select(F.col("v").alias("n"), F.col("u").alias("x")).join(least, "n")
        large = written(large.select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large", files)
        # Small star: each node's smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = written(contracted(small.where("u <> v").distinct()), "edges", files)
        dropped(large)
        dropped(edges)
        edges = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def labels(star: DataFrame) -> DataFrame:
    """A table of stars() -> (id, component_id), the centres among the ids."""
    return star.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(star.select("v", "v")).distinct()


def components(links: DataFrame, rows: int, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) links between up to `rows` ids -> (id, component_id), component_id the smallest
    id reachable. Only ids with a link appear."""
    return labels(stars(links.select(F.col(a).alias("a"), F.col(b).alias("b")), rows))


#: Rounds in which each stray is checked against its nearest candidate only.
ROUNDS = 4


def resolve(found: DataFrame, rows: int, verify, across, screen=None) -> DataFrame:
    """Components of a similarity join of up to `rows` ids whose candidates come in key groups.

    found: rows (gram null, a, b) are pairs to check; rows (gram, a, b) say that id
    a (of size b) is in the large group of key gram, of which only pairs with few
    members are among the pairs. screen(pairs) drops pairs that cannot be links;
    verify(pairs (a, b)) keeps the links; across(groups (gram, doc_id, n, component_id,
    stray), round) gives pairs (a, b) of each stray, a member outside its group's largest
    component, with all members of other components that may be links, or, in rounds above 0, with the
    likeliest of some members alone. Each id is checked against
    its least candidate first, then all other pairs; then come rounds over the large groups
    of several components, each stray against its nearest, as long as a tenth of these join components, and
    at last all that such groups still hold. Pairs that
    the components join need no check; all others get one. -> (id, component_id) of ids with links.
    """
    files = few(rows)
    pairs = written(screen(found_pairs(found)) if screen else found_pairs(found), "pairs", files)
    least = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "least", files)
    star = stars(verify(least), rows)
    seen = [pairs]
    tables = [least]

    def labelled(df: DataFrame, key: str, to: str) -> DataFrame:
        c = labels(star).select(F.col("id").alias("__id"), F.col("component_id").alias("__c"))
        return df.join(c, df[key] == F.col("__id"), "left").withColumn(to, F.coalesce("__c", key)).drop("__id", "__c")

    def more(links: DataFrame) -> DataFrame:
        new = stars(star.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links), rows)
        dropped(star)
        return new

    apart = labelled(labelled(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    rest = written(apart.join(least, ["a", "b"], "left_anti"), "rest", files)
    tables.append(rest)
    if not rest.isEmpty():
        star = more(verify(rest))
    groups = found.where("gram is not null").select("gram", F.col("a").alias("doc_id"), F.col("b").alias("n")).distinct()
    left = ROUNDS
    while True:
        large = written(labelled(groups, "doc_id", "component_id"), "groups", files)
        tables.append(large)
        # Groups of several components; of those with the same members, one.
        parts = large.groupBy("gram", "component_id").agg(F.count("*").alias("members"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.expr("bit_xor(xxhash64(doc_id, 1))").alias("x"))
        main = parts.groupBy("gram").agg(F.max(F.struct("members", -F.col("component_id"))).alias("m"), F.count("*").alias("parts"), F.sum("s").alias("s"), F.expr("bit_xor(x)").alias("x"), F.sum("members").alias("all"))
        main = main.where("parts > 1").dropDuplicates(["s", "x", "all"]).select("gram", (-F.col("m.col2")).alias("main"))
        main = written(main, "mixed", files)
        tables.append(main)
        if main.isEmpty():
            break
        strays = large.join(main, "gram").withColumn("stray", F.col("component_id") != F.col("main")).drop("main")
        others = across(strays, left)
        for t in seen:
            others = others.join(t, ["a", "b"], "left_anti")
        others = written(others, "across", files)
        seen.append(others)
        groups = strays.select("gram", "doc_id", "n")  # no other group can have several components later
        if left == 0:
            if not others.isEmpty():
                star = more(verify(others))
            break
        before = star.count()
        left -= 1
        if not others.isEmpty():
            star = more(verify(others))
        if (star.count() - before) * 10 <= others.count():  # most of what is left are no links
            left = 0
    for t in tables + seen:
        dropped(t)
    return labels(star)


def found_pairs(found: DataFrame) -> DataFrame:
    return found.where("gram is null").select("a", "b").distinct()

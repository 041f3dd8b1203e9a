"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key; (source, leading digits of the key) are
the ranges, so no sampling is needed to cut them evenly and a source that
holds a third of all rows is cut as finely as its rows ask. Sums of ranges give
each range's place in its source, a window inside a range the rest. A source
takes its target in whole epochs and then the documents at the front of its
order, cutting the last one, so that the words taken equal the target rounded.

Nulls: a null text has size 0, a null source is a source of its own (last in
order). Repeated rows are separate documents; ties of the key are broken by id
and size. Empty tables give empty results. Extra columns pass through `plan`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinvec.llm.common import WORD, few, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows of one range, at most, as expected under a random key.
RANGE_ROWS = 2048
P = "__mix_"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) one row per source -> (source, source_size, target).

    Sources by code point, null last, weigh `weights` in turn. A source's
    target is its share of all words, at most `epochs` times its own; what is
    cut off there is shared anew by weight. The level at which weight * level
    meets that is found by one pass over the sources in order of cap / weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    t = sums.withColumn("i", F.row_number().over(order) - 1).withColumn("w", weight.cast("long"))
    before = W.orderBy(F.col("size") * epochs / F.col("w"), "i").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    t = t.withColumn("left_size", F.sum("size").over(everything) - F.coalesce(F.sum(F.col("size") * epochs).over(before), F.lit(0)))
    t = t.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("level", F.max(F.col("left_size") / F.col("left_w")).over(everything))
    return t.select(
        "source",
        F.col("size").alias("source_size"),
        F.least(F.col("w") * F.col("level"), (F.col("size") * epochs).cast("double")).alias("target"),
    )


def keyed(docs: DataFrame, rows: int, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """Adds key (hex digits) and its leading digits, the range."""
    levels = max(1, math.ceil(math.log(max(rows, 1) / RANGE_ROWS, 256))) if rows > RANGE_ROWS else 1
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return docs.withColumn(P + "key", key).withColumn(P + "range", F.substring(P + "key", 1, 2 * min(levels, 8)))


def _offsets(ranges: DataFrame, digits: int) -> DataFrame:
    """(source, range, size) -> with start, the words of the source's earlier
    ranges. Two digits at a time: no window holds more than 256 rows."""
    same = F.col("source").eqNullSafe(F.col("r_source"))
    out = ranges.withColumn("start", F.lit(0).cast("long"))
    for n in range(2, digits + 1, 2):
        part = ranges.groupBy("source", F.substring("range", 1, n).alias("p")).agg(F.sum("size").alias("size"))
        w = W.partitionBy("source", F.substring("p", 1, n - 2)).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
        part = part.select(F.col("source").alias("r_source"), "p", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("more"))
        out = out.join(part, same & (F.substring("range", 1, n) == F.col("p"))).withColumn("start", F.col("start") + F.col("more")).drop("r_source", "p", "more")
    return out


def plan(docs: DataFrame, weights=WEIGHTS, epochs: int = MAX_EPOCHS, seed: str = "mix", rows: int | None = None,
         size: Column | None = None) -> DataFrame:
    """Adds to every row __mix_size, __mix_source_size, __mix_target,
    __mix_full (whole epochs) and __mix_cut (words of the last, partial one)."""
    rows = docs.count() if rows is None else rows
    size = size_of(F.col("text")) if size is None else size
    d = keyed(docs.withColumn(P + "size", size), rows, seed)
    ranges = d.groupBy("source", F.col(P + "range").alias("range")).agg(F.sum(P + "size").alias("size"))
    ranges = written(ranges, "ranges", few(rows))
    digits = 2 * min(8, max(1, math.ceil(math.log(max(rows, 1) / RANGE_ROWS, 256)) if rows > RANGE_ROWS else 1))
    goal = targets(ranges.groupBy("source").agg(F.sum("size").alias("size")), weights, epochs).withColumnRenamed("source", "g_source")
    ranges = (
        _offsets(ranges, digits)
        .join(goal, F.col("source").eqNullSafe(F.col("g_source")))
        .select(F.col("source").alias(P + "s"), F.col("range").alias(P + "r"), F.col("start").alias(P + "start"),
                F.col("source_size").alias(P + "source_size"), F.col("target").alias(P + "target"))
    )
    ranges = written(ranges, "placed", few(rows))
    inside = W.partitionBy("source", P + "range").orderBy(P + "key", "doc_id", P + "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn(P + "before", F.coalesce(F.sum(P + "size").over(inside), F.lit(0)))
    d = d.join(ranges, F.col("source").eqNullSafe(F.col(P + "s")) & (F.col(P + "range") == F.col(P + "r")))
    budget = F.round(P + "target").cast("long")
    d = d.withColumn(P + "full", F.when(F.col(P + "source_size") > 0, F.floor(budget / F.col(P + "source_size"))).otherwise(F.lit(0)).cast("long"))
    rest = budget - F.col(P + "full") * F.col(P + "source_size") - F.col(P + "start") - F.col(P + "before")
    d = d.withColumn(P + "cut", F.greatest(F.lit(0), F.least(F.col(P + "size"), rest)).cast("long"))
    return d.drop(P + "key", P + "range", P + "before", P + "start", P + "s", P + "r")


def mix(docs: DataFrame, rows: int | None = None, **options) -> DataFrame:
    """The mixed corpus: each document once per epoch that takes it; the one at
    a source's cut holds the words taken there, with the space between them."""
    columns = docs.columns
    rows = docs.count() if rows is None else rows
    d = plan(docs, rows=rows, **options)
    # Ends at the last whole word that is taken.
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col(P + "cut").cast("int")), "")
    whole = F.array_repeat(F.lit(False), F.col(P + "full").cast("int"))
    last = F.when(F.col(P + "cut") > 0, F.array(F.col(P + "cut") < F.col(P + "size"))).otherwise(F.array().cast("array<boolean>"))
    d = d.withColumn(P + "part", F.explode(F.concat(whole, last)))
    return d.withColumn("text", F.when(F.col(P + "part"), head).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in columns]).coalesce(few(rows, 8000, 12))

"""SQL functions of the engine, for spark.sql texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

_RANGES = "ARRAY<STRUCT<lo: DOUBLE, hi: DOUBLE>>"
#: name -> (parameters, type, body): SQL functions, which Catalyst inlines.
SQL_FUNCTIONS = {
    "l2_sq": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (p, q) -> (p - q) * (p - q)), 0D, (s, t) -> s + t)"),
    "l2": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (p, q) -> (p - q) * (p - q)), 0D, (s, t) -> s + t))"),
    "cosine_sim": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "aggregate(zip_with(a, b, (p, q) -> p * q), 0D, (s, t) -> s + t) / sqrt(aggregate(a, 0D, (s, t) -> s + t * t) * aggregate(b, 0D, (s, t) -> s + t * t))",
    ),
    "fuse": ("alpha DOUBLE, dx2 DOUBLE, dy2 DOUBLE", "DOUBLE", "alpha * sqrt(greatest(0D, dx2)) + (1 - alpha) * sqrt(greatest(0D, dy2))"),
    # A (0, 0) slot or an end outside 0..1 ends the list.
    "alpha_active": (
        f"ranges {_RANGES}, alpha DOUBLE", "BOOLEAN",
        "size(ranges) = 0 OR exists(slice(ranges, 1, coalesce(array_min(filter(transform(ranges, (r, i) -> CASE WHEN (r.lo = 0 AND r.hi = 0) OR r.lo < 0 OR r.hi > 1 THEN i END), i -> i IS NOT NULL)), "
        "size(ranges))), r -> r.lo <= alpha AND alpha <= r.hi)",
    ),
    "range_union": (
        f"ranges {_RANGES}", _RANGES,
        f"aggregate(array_sort(ranges), CAST(array() AS {_RANGES}), (acc, r) -> CASE WHEN size(acc) > 0 AND r.lo <= element_at(acc, -1).hi "
        "THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('lo', element_at(acc, -1).lo, 'hi', greatest(element_at(acc, -1).hi, r.hi)))) ELSE concat(acc, array(r)) END)",
    ),
    "range_complement": (
        f"ranges {_RANGES}, least DOUBLE", _RANGES,
        "filter(zip_with(concat(array(0D), transform(range_union(ranges), r -> r.hi)), concat(transform(range_union(ranges), r -> r.lo), array(1D)), (a, b) -> named_struct('lo', a, 'hi', b)), "
        "r -> round(r.hi - r.lo, 9) >= least)",
    ),
    "range_quantise": (
        f"ranges {_RANGES}", "ARRAY<STRUCT<lo: TINYINT, hi: TINYINT>>",
        "transform(ranges, r -> named_struct('lo', CAST(floor(round(r.lo * 100, 9)) AS TINYINT), 'hi', CAST(ceil(round(r.hi * 100, 9)) AS TINYINT)))",
    ),
    "recall_at_k": ("found ARRAY<BIGINT>, truth ARRAY<BIGINT>, k INT", "DOUBLE", "size(array_intersect(found, slice(truth, 1, k))) * 100D / k"),
    "range_intersect": (
        "ranges ARRAY<STRUCT<lo: DOUBLE, hi: DOUBLE>>, a DOUBLE, b DOUBLE", "ARRAY<STRUCT<lo: DOUBLE, hi: DOUBLE>>",
        "filter(transform(ranges, r -> named_struct('lo', greatest(r.lo, a), 'hi', least(r.hi, b))), r -> r.lo < r.hi)",
    ),
    "topk_pool": ("pool ARRAY<STRUCT<dist: DOUBLE, id: BIGINT>>, k INT", "ARRAY<STRUCT<dist: DOUBLE, id: BIGINT>>", "slice(array_sort(array_distinct(pool)), 1, k)"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (params, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return sorted(SQL_FUNCTIONS)

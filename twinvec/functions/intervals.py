"""Interval sets of weights in [0, 1], as array<struct<lo, hi>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<lo:double,hi:double>>"
EMPTY = F.array  # called lazily: needs a session


def span(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def none() -> Column:
    return F.array().cast(TYPE)


def half_plane(slope: Column, rhs: Column, corrected: bool = True) -> Column:
    """The weights a of [0, 1] with slope * a <= rhs, as a struct, or null if none.
    corrected: a flat slope with rhs >= 0 holds everywhere; otherwise a zero slope or
    a zero rhs holds nowhere."""
    root = rhs / slope
    flat = F.when(rhs >= 0, span(F.lit(0.0), F.lit(1.0)))
    up = F.when(root >= 0, span(F.lit(0.0), F.least(F.lit(1.0), root)))
    down = F.when(root <= 1, span(F.greatest(F.lit(0.0), root), F.lit(1.0)))
    out = F.when(slope == 0, flat).when(slope > 0, up).otherwise(down)
    return out if corrected else F.when((slope != 0) & (rhs != 0), out)


def intersect(ranges: Column, lo: Column, hi: Column) -> Column:
    """Each range cut to [lo, hi]; those without inner points go."""
    cut = F.transform(ranges, lambda r: span(F.greatest(r.lo, lo), F.least(r.hi, hi)))
    return F.filter(cut, lambda r: r.lo < r.hi)


def union(ranges: Column) -> Column:
    """Sorted disjoint ranges; ranges that touch become one."""

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(span(last.lo, F.greatest(last.hi, r.hi))))
        return F.when((F.size(acc) > 0) & (r.lo <= last.hi), joined).otherwise(F.concat(acc, F.array(span(r.lo, r.hi))))

    return F.aggregate(F.array_sort(ranges), none(), step)


def complement(ranges: Column, least: float = 0.01) -> Column:
    """[0, 1] without the union of the ranges; gaps under `least` go."""
    u = union(ranges)
    lo = F.concat(F.array(F.lit(0.0)), F.transform(u, lambda r: r.hi))
    hi = F.concat(F.transform(u, lambda r: r.lo), F.array(F.lit(1.0)))
    return F.filter(F.zip_with(lo, hi, span), lambda r: F.round(r.hi - r.lo, 9) >= least)


def quantize(ranges: Column, outward: bool = True) -> Column:
    """Hundredths as array<struct<lo, hi>> of tinyint. outward: down and up, so that no
    weight is lost; otherwise both towards zero."""
    put = lambda c, f: f(F.round(c * 100, 9)).cast("tinyint")
    up = F.ceil if outward else F.floor
    return F.transform(ranges, lambda r: F.struct(put(r.lo, F.floor).alias("lo"), put(r.hi, up).alias("hi")))


def width(ranges: Column) -> Column:
    return F.aggregate(union(ranges), F.lit(0.0), lambda s, r: s + (r.hi - r.lo))


def active(ranges: Column, alpha: Column) -> Column:
    """Whether an edge of hundredth ranges serves a weight: no ranges, or one that
    holds 100 * alpha, ends included. A (0, 0) slot or an endpoint outside 0..100
    ends the list."""
    stop = F.transform(ranges, lambda r, i: F.when(((r.lo == 0) & (r.hi == 0)) | (r.lo < 0) | (r.hi > 100), i))
    n = F.coalesce(F.array_min(F.filter(stop, lambda i: i.isNotNull())), F.size(ranges))
    a = F.round(alpha * 100, 6)
    return (F.size(ranges) == 0) | F.exists(F.slice(ranges, F.lit(1), n), lambda r: (r.lo <= a) & (a <= r.hi))


def compress(ranges: Column, most: int = 2, method: str = "gap") -> Column:
    """At most `most` ranges that cover the given ones.

    gap: joins the neighbours with the smallest gap, the first of equals, until few
    enough are left. split: for two ranges, cuts once, at the largest uncovered gap,
    the first of equals. Since a gap once joined changes no other gap, both keep the
    widest gaps; they differ in that split keeps one gap whatever `most` is."""
    keep = most - 1 if method == "gap" else 1
    u = F.filter(union(ranges), lambda r: r.lo <= r.hi)

    def build(u: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(1), F.size(u) - 1),
            lambda i: F.struct(-(F.get(u, i).lo - F.get(u, i - 1).hi).alias("g"), (-i if method == "gap" else i).alias("k"), i.alias("i")),
        )
        cuts = F.array_sort(F.transform(F.slice(F.array_sort(gaps), F.lit(1), F.lit(keep)), lambda x: x.i))
        first = F.concat(F.array(F.lit(0)), cuts)
        last = F.concat(cuts, F.array(F.size(u)))
        return F.zip_with(first, last, lambda a, b: span(F.get(u, a).lo, F.get(u, b - 1).hi))

    return F.when(F.size(u) <= 1, u).otherwise(build(u))

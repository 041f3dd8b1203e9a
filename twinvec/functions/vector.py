"""Column expressions over vectors stored as arrays. Sums run in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two distance contracts: `euclid` fuses distances, `legacy` fuses their squares.
CONTRACTS = ("euclid", "legacy")


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(as_double(a), as_double(b), lambda p, q: p * q))


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null if a length differs."""
    d = _fold(F.zip_with(as_double(a), as_double(b), lambda p, q: (p - q) * (p - q)))
    return F.when(F.size(a) == F.size(b), d)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_sq(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(_fold(F.transform(as_double(v), lambda x: x * x)))


def l2_normalize(v: Column, eps: float = 0.0) -> Column:
    """v / sqrt(eps + |v|^2); a zero vector stays as it is when eps is 0."""
    n = F.sqrt(_fold(F.transform(as_double(v), lambda x: x * x)) + eps)
    return F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def cosine_similarity(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


METRICS = {"l2": l2_sq, "cosine": cosine_distance}


def metric(name: str):
    """The distance of a metric by name; others than l2 and cosine are refused."""
    if name not in METRICS:
        raise ValueError(f"metric {name!r} is not supported: use one of {sorted(METRICS)}")
    return METRICS[name]


def fuse(alpha: Column, dx2: Column, dy2: Column, contract: str = "euclid") -> Column:
    """alpha weighs space x, 1 - alpha space y, over squared distances."""
    if contract == "legacy":
        return alpha * dx2 + (1 - alpha) * dy2
    if contract != "euclid":
        raise ValueError(f"contract {contract!r}: use one of {CONTRACTS}")
    return alpha * F.sqrt(F.greatest(F.lit(0.0), dx2)) + (1 - alpha) * F.sqrt(F.greatest(F.lit(0.0), dy2))


def concat_distance(dx2: Column, dy2: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), dx2 + dy2))


def contribution_share(alpha: Column, dx: Column, dy: Column) -> Column:
    """What part of the fused distance space x gives; null if it is 0."""
    total = alpha * dx + (1 - alpha) * dy
    return F.when(total > 0, alpha * dx / total)


def permute(v: Column, order: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.get(v, i))


def pad(v: Column, multiple: int = 8) -> Column:
    """Zeros up to the next multiple of the length; distances stay."""
    return F.concat(v, F.array_repeat(F.lit(0.0), (-F.size(v)) % multiple + F.when((-F.size(v)) % multiple < 0, multiple).otherwise(0)))


def unpad(v: Column, dim: int) -> Column:
    return F.slice(v, 1, dim)


#: Element types of vector files and the columns that hold them.
KINDS = {"double": "double", "float": "float", "int32": "int", "int8": "tinyint", "uint8": "smallint"}


def convert(v: Column, kind: str) -> Column:
    """Elements of another type, cut towards zero; a value that the type cannot hold fails."""
    whole = {"int32": (-(1 << 31), (1 << 31) - 1), "int8": (-128, 127), "uint8": (0, 255)}
    if kind not in KINDS:
        raise ValueError(f"type {kind!r}: use one of {sorted(KINDS)}")
    if kind not in whole:
        return v.cast(f"array<{KINDS[kind]}>")
    lo, hi = whole[kind]
    cut = lambda e: F.when(e >= 0, F.floor(e)).otherwise(F.ceil(e))
    put = lambda e: F.when(cut(e).between(lo, hi) | e.isNull(), cut(e)).otherwise(F.raise_error(F.lit(f"a value beyond {kind}")).cast("bigint"))
    return F.transform(as_double(v), lambda e: put(e).cast(KINDS[kind]))


def fp16_bits(x: Column) -> Column:
    """The bits of a number in half precision, rounded to even, as an int. Zero has no sign."""
    a = F.abs(x.cast("double"))
    # The exponent may come out one too small at a power of two: the fraction then carries into it.
    e = F.greatest(F.floor(F.log2(a)).cast("int"), F.lit(-14))
    bits = (e + 14) * 1024 + F.rint(a * F.pow(F.lit(2.0), 10 - e)).cast("int")
    size = F.when(F.isnan(a), 0x7E00).when(a == 0, 0).when(a >= 65520, 0x7C00).otherwise(bits)
    return (size + F.when(x < 0, 0x8000).otherwise(0)).cast("int")


def fp16_value(bits: Column) -> Column:
    e, m = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    size = F.when(e == 0, m * 2.0**-24).when((e == 31) & (m == 0), float("inf")).when(e == 31, float("nan")).otherwise((m + 1024) * F.pow(F.lit(2.0), e - 25))
    return F.when(bits >= 0x8000, -size).otherwise(size)


def residual(v: Column, centre: Column, subtract: bool = True) -> Column:
    """v without its centre, or with it again."""
    return F.zip_with(as_double(v), as_double(centre), (lambda a, b: a - b) if subtract else (lambda a, b: a + b))


def pq_chunks(dim: int, budget_bytes: float, points: int, most: int = 512) -> int:
    """Code bytes a point under a memory budget: at least 1, at most dim and `most`."""
    return max(1, min(dim, most, int(math.floor(budget_bytes / max(points, 1)))))


def training_size(points: int) -> int:
    return max(1, min(points // 10, 256_000))

"""Product quantisation: codebooks, codes and table look-ups.

A codebook is (space, chunk, code, centroid) rows, `codes` a chunk, and a mean a
space; it is bounded by chunks * codes * dimension, which is what gets broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CODES, ITERATIONS, SAMPLE = 256, 15, 256_000


def chunk_bounds(dim: int, chunks: int) -> list[int]:
    """Where chunks begin: sizes differ by one at most, larger ones first."""
    base, more = divmod(dim, chunks)
    return [0, *np.cumsum([base + (i < more) for i in range(chunks)]).tolist()]


def _chunked(points: DataFrame, bounds: list[int]) -> DataFrame:
    parts = F.array(*[F.slice("vec", a + 1, b - a) for a, b in zip(bounds, bounds[1:], strict=False)])
    return points.select("id", F.posexplode(parts).alias("chunk", "part"))


def fixed_codebook(points: DataFrame, chunks: int, dim: int, codes: int = CODES) -> DataFrame:
    """The rows of the smallest ids as centroids, without training -> chunk, code, centroid."""
    first = points.orderBy("id").limit(codes)
    first = first.withColumn("code", F.row_number().over(W.orderBy("id")) - 1)
    parts = _chunked(first.select(F.col("code").alias("id"), "vec"), chunk_bounds(dim, chunks))
    return parts.select(F.col("chunk").cast("long"), F.col("id").cast("long").alias("code"), F.col("part").cast("array<double>").alias("centroid"))


def train(points: DataFrame, chunks: int, dim: int, codes: int = CODES, sample: int = SAMPLE, seed: int = 42, iterations: int = ITERATIONS) -> DataFrame:
    """k-means for each chunk over a bounded sample by hash of the id."""
    n = points.count()
    part = min(1.0, sample / max(n, 1))
    chosen = points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < part)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack([np.asarray(v, np.float64) for v in pdf["part"]])
        c = kmeans(x, codes, seed + int(pdf["chunk"].iloc[0]), iterations)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "code": np.arange(len(c)), "centroid": list(c)})

    return _chunked(chosen, chunk_bounds(dim, chunks)).groupBy("chunk").applyInPandas(fit, "chunk long, code long, centroid array<double>")


def kmeans(x: np.ndarray, k: int, seed: int, iterations: int = ITERATIONS, tolerance: float = 1e-5) -> np.ndarray:
    """Lloyd rounds from k-means++ seeds, until the error falls by less than `tolerance`
    of itself; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = near.sum()
        centres.append(x[rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    c, last = np.array(centres), np.inf
    for _ in range(iterations):
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        of = d.argmin(axis=1)
        count = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
        error = float(np.maximum(0, d[np.arange(len(x)), of]).sum())
        if np.isfinite(last) and last - error < tolerance * max(last, 1e-12):
            break
        last = error
    return c


def _books(codebook: DataFrame) -> list[np.ndarray]:
    books: dict[int, dict[int, list]] = {}
    rows = codebook.limit((1 << 20) + 1).collect()
    if len(rows) > 1 << 20:
        raise ValueError(f"a codebook of over {1 << 20} centroids")
    for r in rows:
        books.setdefault(r.chunk, {})[r.code] = r.centroid
    return [np.array([b[c] for c in sorted(b)]) for _, b in sorted(books.items())]


def encode(points: DataFrame, codebook: DataFrame) -> DataFrame:
    """-> id, codes array<smallint>; ties go to the smaller code."""
    shared = points.sparkSession.sparkContext.broadcast(_books(codebook))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, np.float64) for v in pdf["vec"]])
            a, codes = 0, []
            for book in shared.value:
                part = x[:, a : a + book.shape[1]]
                a += book.shape[1]
                codes.append(((part[:, None, :] - book[None]) ** 2).sum(2).argmin(1) if len(book) * len(part) <= 1 << 16 else ((part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)).round(12).argmin(1))
            yield pd.DataFrame({"id": pdf["id"], "codes": list(np.stack(codes, axis=1).astype(np.int16))})

    return points.select("id", "vec").mapInPandas(run, "id long, codes array<smallint>")


def adc_search(codes: DataFrame, queries: DataFrame, codebook: DataFrame, k: int = 10, codes_y: DataFrame | None = None, codebook_y: DataFrame | None = None,
               contract: str = "euclid", exclude_self: bool = True, digits: int | None = None) -> DataFrame:
    """The k nearest by table look-up: each query's distances to all centroids, summed
    over a row's codes. With a second space, fused by the query's alpha.
    queries: a stated set (qid, x[, y, alpha])."""
    two = codes_y is not None
    q = queries.orderBy("qid").collect()
    books, books_y = _books(codebook), _books(codebook_y) if two else None

    def tables(vec, bs):
        out, a = [], 0
        for b in bs:
            out.append(((b - np.asarray(vec[a : a + b.shape[1]], np.float64)) ** 2).sum(1))
            a += b.shape[1]
        return np.stack(out)

    shared = codes.sparkSession.sparkContext.broadcast(
        [(r.qid, tables(r.x, books), tables(r.y, books_y) if two else None, float(r.alpha) if two else 1.0) for r in q]
    )
    rows = codes.join(codes_y.select("id", F.col("codes").alias("codes_y")), "id") if two else codes

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            c = np.stack(pdf["codes"].to_list()).astype(np.int64)
            cy = np.stack(pdf["codes_y"].to_list()).astype(np.int64) if two else None
            ids, chunk = pdf["id"].to_numpy(), np.arange(c.shape[1])
            for qid, tx, ty, alpha in shared.value:
                d = tx[chunk, c].sum(1)
                if two:
                    dy = ty[np.arange(cy.shape[1]), cy].sum(1)
                    d = alpha * d + (1 - alpha) * dy if contract == "legacy" else alpha * np.sqrt(d) + (1 - alpha) * np.sqrt(dy)
                if exclude_self:
                    d = np.where(ids == qid, np.inf, d)
                keep = np.argsort(np.round(d, 9), kind="stable")
                keep = keep[np.lexsort((ids[keep], np.round(d[keep], 9)))][: k + 8]
                keep = keep[np.isfinite(d[keep])]
                yield pd.DataFrame({"qid": qid, "id": ids[keep], "dist": d[keep]})

    got = rows.mapInPandas(run, "qid long, id long, dist double")
    if digits is not None:
        got = got.withColumn("dist", F.round("dist", digits))
    w = W.partitionBy("qid").orderBy("dist", "id")
    return got.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def code_distance(codes: DataFrame, pairs: DataFrame, codebook: DataFrame) -> DataFrame:
    """pairs (a, b) of ids -> the squared distance between their decoded vectors."""
    left = codes.select(F.col("id").alias("a"), F.posexplode("codes").alias("chunk", "ca"))
    right = codes.select(F.col("id").alias("b"), F.posexplode("codes").alias("chunk", "cb"))
    c1 = codebook.select(F.col("chunk").cast("int").alias("chunk"), F.col("code").alias("ca"), F.col("centroid").alias("va"))
    c2 = codebook.select(F.col("chunk").cast("int").alias("chunk"), F.col("code").alias("cb"), F.col("centroid").alias("vb"))
    j = pairs.join(left, "a").join(right, ["b", "chunk"]).join(c1, ["chunk", "ca"]).join(c2, ["chunk", "cb"])
    from twinvec.functions.vector import l2_sq

    return j.groupBy("a", "b").agg(F.sum(l2_sq(F.col("va"), F.col("vb"))).alias("d2"))


def joined(first: DataFrame, second: DataFrame) -> DataFrame:
    """One codebook of two: the second's codes follow the first's. Encoding takes, chunk by chunk, the nearer of both,
    and distances between codes cross them."""
    sizes = first.groupBy("chunk").agg(F.count("*").alias("__n"))
    after = second.join(F.broadcast(sizes), "chunk").withColumn("code", (F.col("code") + F.col("__n")).cast(first.schema["code"].dataType)).drop("__n")
    return first.unionByName(after.select(*first.columns))


def branches(codes: DataFrame, first_codes: int) -> DataFrame:
    """id, chunk, code, branch: 0 the first codebook, 1 the second."""
    c = codes.select("id", F.posexplode("codes").alias("chunk", "code"))
    return c.select("id", F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"), (F.col("code") >= first_codes).cast("int").alias("branch"))


def refine(points: DataFrame, codebook: DataFrame, worst: float = 0.2, seed: int = 42) -> DataFrame:
    """Second codebook for each chunk, trained on its worst-encoded part of the points
    (a bounded sample of them) -> chunk, code, centroid."""
    books = _books(codebook)
    bounds = np.cumsum([0, *[b.shape[1] for b in books]]).tolist()
    shared = points.sparkSession.sparkContext.broadcast(books)

    def errors(batches):
        for pdf in batches:
            for chunk, g in pdf.groupby("chunk"):
                x, b = np.stack(g["part"].to_list()), shared.value[chunk]
                d = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ b.T + (b * b).sum(1)).min(1)
                yield g.assign(err=d)

    err = _chunked(points, bounds).mapInPandas(errors, "id long, chunk long, part array<double>, err double")
    cut = err.groupBy("chunk").agg(F.percentile_approx("err", 1 - worst).alias("cut"), F.count("*").alias("n"))
    bad = err.join(cut, "chunk").where(F.col("err") >= F.col("cut"))
    bad = bad.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.lit(SAMPLE) / (F.col("n") * worst))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        chunk = int(pdf["chunk"].iloc[0])
        c = kmeans(np.stack(pdf["part"].to_list()), len(shared.value[chunk]), seed + chunk)
        return pd.DataFrame({"chunk": chunk, "code": np.arange(len(c)), "centroid": list(c)})

    return bad.select("id", "chunk", "part").groupBy("chunk").applyInPandas(fit, "chunk long, code long, centroid array<double>")

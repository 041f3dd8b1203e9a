"""The two-space view of `embeddings` that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries are the rows whose id is divisible by EVERY, against all rows.
HALF, EVERY = 32, 20


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("id"), F.slice(v, 1, HALF).alias("x"), F.slice(v, HALF + 1, HALF).alias("y"), v.alias("e"), "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set that grows with the table, each with a weight."""
    p = points(spark, sf_dir).where(F.col("id") % EVERY == 0)
    return p.select(F.col("id").alias("qid"), "x", "y", "e", ((F.col("id") % 11) / 10.0).alias("alpha"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ranges: up to five overlapping intervals of hundredths an id."""
    p = points(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), (F.col("id") % 6).cast("int") - 1)).alias("slot")).where("slot >= 0 and slot < id % 6")
    lo = (F.col("id") * 37 + F.col("slot") * 23) % 90 + 1
    hi = F.least(F.lit(100), lo + (F.col("id") * 13 + F.col("slot") * 29) % 40 + 1)
    r = p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((lo / 100.0).alias("lo"), (hi / 100.0).alias("hi")))).alias("ranges"))
    return r


def sql_sq(a: str, b: str, n: int = HALF) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


SQL = f"""v AS (SELECT vec_id AS id, CAST(embedding[1:{HALF}] AS DOUBLE[]) AS x, CAST(embedding[{HALF + 1}:{2 * HALF}] AS DOUBLE[]) AS y, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
q AS (SELECT id AS qid, x AS qx, y AS qy, e AS qe, CAST(id % 11 AS DOUBLE) / 10 AS alpha FROM v WHERE id % {EVERY} = 0),
d AS (SELECT qid, alpha, id, {sql_sq("qx", "x")} AS dx2, {sql_sq("qy", "y")} AS dy2 FROM q, v WHERE qid <> id)"""
SQL_INTERVALS = """iv AS (SELECT vec_id AS id, s.slot, CAST((vec_id * 37 + s.slot * 23) % 90 + 1 AS DOUBLE) / 100 AS lo,
  CAST(least(100, (vec_id * 37 + s.slot * 23) % 90 + 1 + (vec_id * 13 + s.slot * 29) % 40 + 1) AS DOUBLE) / 100 AS hi
  FROM embeddings, (SELECT unnest(range(0, 5)) AS slot) s WHERE s.slot < vec_id % 6),
un AS (SELECT id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN lo <= m THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY lo, hi, slot) AS g
  FROM (SELECT *, max(hi) OVER (PARTITION BY id ORDER BY lo, hi, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv)) GROUP BY id, g)"""

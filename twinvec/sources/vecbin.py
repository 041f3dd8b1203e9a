"""Readers and writers of vector files.

bin: [rows u32][dim u32][rows * dim values]; fvecs, ivecs and bvecs: a u32 dimension
before each row; truthset: [queries u32][k u32][ids u32][distances f32][tags u32], the
last two left out or there by the file's size. All little-endian. Files are read
by ranges of rows, a task each, through a data source; a path is anything that
pyarrow's file systems open.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from twinvec.functions.vector import l2_normalize

DTYPES = {"float": ("<f4", 4, "array<float>"), "int8": ("<i1", 1, "array<tinyint>"), "uint8": ("<u1", 1, "array<smallint>"), "int32": ("<i4", 4, "array<int>")}
VECS = {"fvecs": "float", "bvecs": "uint8", "ivecs": "int32"}
RANGE_BYTES = 32 << 20


def _open(path: str):
    system, where = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"{path}")
    return system, where


def _size(path: str) -> int:
    system, where = _open(path)
    info = system.get_file_info(where)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def header(path: str) -> tuple[int, int]:
    """(rows, dim) of a bin file."""
    system, where = _open(path)
    with system.open_input_file(where) as f:
        head = f.read(8)
    if len(head) < 8:
        raise ValueError(f"{path}: no header")
    return struct.unpack("<II", head)


class _Range(InputPartition):
    def __init__(self, first: int, rows: int):
        super().__init__((first, rows))
        self.first, self.rows = first, rows


class _VecReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("format", "bin")
        self.dtype = VECS.get(self.kind) or options.get("dtype", "float")
        self.code, self.width, _ = DTYPES[self.dtype]
        size = _size(self.path)
        if self.kind == "bin":
            self.count, self.dim = header(self.path)
            self.skip, self.row = 8, self.dim * self.width
            if size != 8 + self.count * self.row:
                raise ValueError(f"{self.path}: {size} bytes, but {self.count} rows of {self.dim} take {8 + self.count * self.row}")
        else:
            system, where = _open(self.path)
            with system.open_input_file(where) as f:
                head = f.read(4)
            self.dim = struct.unpack("<I", head)[0] if len(head) == 4 else 0
            self.skip, self.row = 0, 4 + self.dim * self.width
            self.count, rest = divmod(size, self.row)
            if rest:
                raise ValueError(f"{self.path}: {size} bytes are no whole rows of {self.row}")

    def partitions(self):
        step = max(1, RANGE_BYTES // max(1, self.row))
        return [_Range(a, min(step, self.count - a)) for a in range(0, self.count, step)] or [_Range(0, 0)]

    def read(self, partition):
        system, where = _open(self.path)
        with system.open_input_file(where) as f:
            f.seek(self.skip + partition.first * self.row)
            raw = np.frombuffer(f.read(partition.rows * self.row), dtype=np.uint8).reshape(partition.rows, self.row)
        if self.kind != "bin":
            dims = raw[:, :4].copy().view("<u4").ravel()
            if (dims != self.dim).any():
                raise ValueError(f"{self.path}: rows of different dimensions")
            raw = raw[:, 4:]
        x = np.ascontiguousarray(raw).view(self.code).reshape(partition.rows, self.dim)
        if self.dtype == "uint8":
            x = x.astype(np.int16)
        flat = pa.array(x.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(partition.first, partition.first + partition.rows), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(partition.rows + 1) * self.dim, pa.int32()), flat)], names=["id", "vec"]
        )


class VecSource(DataSource):
    """spark.read.format("vecbin").option("dtype", ...).option("format", ...).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        dtype = VECS.get(self.options.get("format", "bin")) or self.options.get("dtype", "float")
        if dtype not in DTYPES:
            raise ValueError(f"dtype {dtype!r}: use one of {sorted(DTYPES)}")
        return f"id long, vec {DTYPES[dtype][2]}"

    def reader(self, schema):
        return _VecReader(dict(self.options))


def read_vectors(spark: SparkSession, path: str, dtype: str = "float", kind: str = "bin") -> DataFrame:
    """-> id (position), vec."""
    spark.dataSource.register(VecSource)
    return spark.read.format("vecbin").option("dtype", dtype).option("format", kind).load(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A bin file of one column of ids -> local (position), id."""
    return read_vectors(spark, path, "int32").select(F.col("id").alias("local"), F.get("vec", 0).cast("long").alias("id"))


def write_vectors(df: DataFrame, path: str, dtype: str = "float", kind: str = "bin", align: int = 0, normalise: bool = False) -> int:
    """(id, vec) in order of id as one file, a row range at a time from the driver; align
    pads the file to a multiple of that many bytes; normalise: vectors of length 1. -> bytes written."""
    df = df.withColumn("vec", l2_normalize(F.col("vec"))) if normalise else df
    code, _, _ = DTYPES[VECS.get(kind, dtype)]
    n, dim = df.count(), df.select(F.max(F.size("vec"))).first()[0] or 0
    system, where = _open(path)
    done = 0
    with system.open_output_stream(where) as f:
        if kind == "bin":
            done += f.write(struct.pack("<II", n, dim))
        for row in df.select("id", "vec").orderBy("id").toLocalIterator(prefetchPartitions=True):
            if len(row.vec) != dim:
                raise ValueError(f"id {row.id}: {len(row.vec)} values instead of {dim}")
            if kind != "bin":
                done += f.write(struct.pack("<I", dim))
            done += f.write(np.asarray(row.vec).astype(code).tobytes())
        if align and done % align:
            done += f.write(b"\0" * (align - done % align))
    return done


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """-> qid, rank, id, dist, tag; dist and tag null where the file has none."""
    size = _size(path)
    n, k = header(path)
    blocks, rest = divmod(size - 8, 4 * n * k) if n * k else (1, 0)
    if rest or blocks not in (1, 2, 3):
        raise ValueError(f"{path}: {size} bytes fit no truth set of {n} x {k}")
    system, where = _open(path)
    with system.open_input_file(where) as f:
        f.seek(8)
        raw = f.read(size - 8)
    part = 4 * n * k
    cols = {"qid": np.repeat(np.arange(n), k), "rank": np.tile(np.arange(1, k + 1), n), "id": np.frombuffer(raw[:part], "<u4").astype(np.int64)}
    dist = np.frombuffer(raw[part : 2 * part], "<f4").astype(np.float64) if blocks > 1 else None
    tag = np.frombuffer(raw[2 * part :], "<u4").astype(np.int64) if blocks > 2 else None
    t = pa.table({**cols, "dist": pa.array(dist) if dist is not None else pa.nulls(n * k, pa.float64()), "tag": pa.array(tag) if tag is not None else pa.nulls(n * k, pa.int64())})
    return spark.createDataFrame(t)


def write_truth(df: DataFrame, path: str, k: int, distances: bool = True) -> None:
    """(qid, rank, id[, dist]) -> a truth set; every query needs k ranks."""
    rows = df.where(F.col("rank") <= k).orderBy("qid", "rank").toPandas()
    n = rows["qid"].nunique()
    if len(rows) != n * k:
        raise ValueError(f"{len(rows)} rows are no {n} queries of {k}")
    system, where = _open(path)
    with system.open_output_stream(where) as f:
        f.write(struct.pack("<II", n, k))
        f.write(rows["id"].to_numpy().astype("<u4").tobytes())
        if distances:
            f.write(rows["dist"].to_numpy().astype("<f4").tobytes())


def join_spaces(x: DataFrame, y: DataFrame) -> DataFrame:
    """Two aligned files -> id, x, y, joined on the explicit id."""
    return x.withColumnRenamed("vec", "x").join(y.withColumnRenamed("vec", "y"), "id")


def identity_tags(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("id").alias("tag"))


def prefix(df: DataFrame, rows: int) -> DataFrame:
    return df.where(F.col("id") < rows)


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows get the ids after the old ones, in order of their own."""
    from twinvec.operators import layout

    first = old.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    at = layout.assign_pages(new, 1).select("id", (F.col("page_id") + first).alias("__at"))
    return old.unionByName(new.join(at, "id").withColumn("id", F.col("__at")).drop("__at"))

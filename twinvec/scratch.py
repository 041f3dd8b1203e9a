"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); only a
    local session without one gets a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="twinvec-")
        sc.setCheckpointDir(found)
    return found


#: Rows a batch between the JVM and Python, and from a Parquet file: rows may hold long texts,
#: and batches of some MB grow the heap and the workers far beyond what they hold.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 512}


def set_small_batches(spark: SparkSession) -> dict[str, str]:
    """-> the settings before."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, rows in BATCHES.items():
        if not 0 < int(before[k]) <= rows:
            spark.conf.set(k, str(rows))
    return before


#: For each local file and folder that it makes, Hadoop forks a process to set the mode, and a fork counts with the
#: whole memory of its JVM until it executes: tables go without checksum files and marks of success, in small row groups.
TABLE_OPTIONS = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "parquet.block.size": str(16 << 20),
}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    before = set_small_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def few(rows: int, each: int = 250_000, least: int = 8) -> int:
    """Files for a table of up to so many rows: many small ones cost more than they hold."""
    return max(least, -(-rows // each))


def written(df: DataFrame, label: str = "t", files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost
    executor costs no recomputation. files: at most so many, by as many tasks."""
    df = df.coalesce(files) if files else df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/twinvec-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.options(**TABLE_OPTIONS).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._twinvec_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes the files of a table from written() that nothing reads any more."""
    path = getattr(df, "_twinvec_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

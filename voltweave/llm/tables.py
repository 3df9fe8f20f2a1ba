"""Session helpers: input tables, work tables in the shared folder, and sizes."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: set[str] = set()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; on a single machine a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="voltweave-shared-")
        _own[spark.sparkContext.applicationId] = named
    return named.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's folder for work tables within the shared one. It goes when the application ends."""
    path = f"{shared_dir(spark)}/voltweave/{spark.sparkContext.applicationId}"
    if path not in _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _made.add(path)
    return path


class WorkTable:
    """A written table that cuts lineage: later stages read files, so a lost executor costs no recomputation of what came before."""

    def __init__(self, df: DataFrame, label: str = "work"):
        self.spark = df.sparkSession
        self.path = f"{work_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; only for tables that no returned plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished jobs, which it does when their handles are collected: first Python's, whose end frees the JVM's in a second round."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


#: What Spark reports for a source whose size it does not know is of this order.
UNKNOWN_BYTES = 1 << 60


def source_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that a plan reads, None if Spark does not know one of them. No job runs. Joins and filters between do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return None if any(n >= UNKNOWN_BYTES for n in sizes) else sum(sizes)


def bucket_count(df: DataFrame, bytes_each: int = 4 << 20, least: int = 16) -> int:
    """Hash buckets for an exchange, in proportion to the input, so that a bucket's size stays the same at every scale; four for each shuffle partition where the input's size is unknown."""
    size = source_bytes(df)
    if size is None:
        return max(least, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // bytes_each))

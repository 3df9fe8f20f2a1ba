"""Tables that cut lineage, in the folder the cluster shares, and global ranks without a single task."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import ConfigurationError

_own: dict[str, str] = {}
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a single machine a temporary one where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="voltweave-")
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


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: a lost executor costs no recomputation of what came before."""
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a work table's files; only where no plan reads them any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Bucketed:
    """A table whose rows are bucketed by some columns: joins and aggregates by them need no shuffle of its rows. The files lie in the shared folder, the name in the session's catalog."""

    spark: SparkSession
    name: str
    path: str

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def unnamed(self) -> DataFrame:
        """The files as a plain table; the name leaves the catalog."""
        out = self.spark.read.schema(self.df.schema).parquet(self.path)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return out

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def bucketed(df: DataFrame, by: list[str], label: str, arranged: bool = False) -> Bucketed:
    """df as a bucketed table.

    arranged: df comes from such a table's rows by joins on those columns, so that its tasks hold a bucket each and are written as they are.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{label}_{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/{name}"
    (df if arranged else df.repartition(n, *by)).write.option("path", path).bucketBy(n, *by).saveAsTable(name)
    return Bucketed(spark, name, path)


#: Row numbers within a partition take the low bits of Spark's unique numbers.
ROW_BITS = (1 << 33) - 1


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a 0-based global rank by some columns, ties in any order.

    Rows are range-partitioned, sorted and written once, with their partition's number and their place in it; a
    partition's offset is the rows of those before it. The table of offsets has a row for each partition, so
    broadcasting it is bounded.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_local": place}), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset")


def failing(condition: Column, kind: type, message: str, value: Column) -> Column:
    """value, or the named error where the condition holds."""
    return F.when(condition, F.raise_error(F.lit(f"[{kind.__name__}] {message}"))).otherwise(value)

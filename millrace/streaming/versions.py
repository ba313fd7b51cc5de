"""Buckets of a Parquet table in numbered versions; through Hadoop's file systems, so any store will do.

A version holds only the buckets that it changes, as folders `version-N/bucket=K`. A table's rows are, for each bucket,
those of the latest complete version that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(attribute: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(attribute), F.lit(buckets))


def _folders(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def _versions(spark: SparkSession, table: str) -> list[str]:
    """Complete versions, oldest first."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    return [v for v in _folders(spark, table) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(v, "_SUCCESS"))]


def in_force(spark: SparkSession, table: str, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket that has one, of the latest complete version with a number below `before`."""
    found: dict[int, str] = {}
    for version in _versions(spark, table):
        if before is None or int(version.rpartition("-")[2]) < before:
            found |= {int(f.rpartition("=")[2]): f for f in _folders(spark, version) if "bucket=" in f}
    return found


def read(spark: SparkSession, table: str, schema: str, before: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows in force, of all buckets or only of some."""
    paths = [f for b, f in in_force(spark, table, before).items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def publish(rows: DataFrame, table: str, attribute: str, number: int, buckets: int = BUCKETS) -> None:
    """Write the buckets of rows as a version; it is in force once Spark has committed it with its success mark."""
    rows.withColumn("bucket", bucket(attribute, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version-{number:012d}")


def expire(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Delete folders of buckets that `keep` later versions have too, and say how many. Two at least are kept, as a batch that is run again reads what was in force before it."""
    if keep < 2:
        raise ValueError("keep two versions of a bucket at least")
    later: dict[str, int] = {}
    gone = 0
    for version in reversed(_versions(spark, table)):
        for folder in [f for f in _folders(spark, version) if "bucket=" in f]:
            name = folder.rpartition("/")[2]
            if later.get(name, 0) >= keep:
                p = spark._jvm.org.apache.hadoop.fs.Path(folder)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
                gone += 1
            later[name] = later.get(name, 0) + 1
    return gone

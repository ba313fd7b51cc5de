"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where a small file would be a single task; large tables keep their splits."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def arabic(text: Column) -> Column:
    """Text in which vowels stand as Arabic letters and digits as Arabic-Indic ones, for tables without Arabic script."""
    return F.translate(text, "aeiou123", "اةأإآ١٢۳")


SQL_ARABIC = "translate(text, 'aeiou123', 'اةأإآ١٢۳')"

"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the scan of a table has fewer splits than the cluster has cores.

    A table of a few megabytes would otherwise be read and tokenized by one task. Splits follow
    the bytes to read (``spark.sql.files.maxPartitionBytes``), so a table with more bytes than
    cores times that size is never shuffled, however few its files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, in whatever store Spark finds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

"""Parquet tables, read so that every core has something to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan, dealt out evenly if its files can't fill one partition for each core.

    A row group is one task's, so a table of a few large ones keeps a few cores busy. What is moved then is less than
    the cores would read in one wave; a table with a full partition for every core is left as it is read.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    whole = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if 1 << 20 < size < cores * whole else rows


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Some columns of a table (all without any named)."""
    rows = spark.read.parquet(path)
    return spread(rows.select(*columns) if columns else rows)

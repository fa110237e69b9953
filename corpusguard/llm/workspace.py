"""Shared storage for intermediate tables, and joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than 1/HEAVY_SHARE of all rows is heavy, so at most HEAVY_SHARE keys can be.
HEAVY_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one in local mode (tests);
    on a cluster that is an error, as every machine would write to a disk of its own."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        place = tempfile.mkdtemp(prefix="corpusguard-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/corpusguard-{uuid.uuid4().hex[:12]}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, no executor holds the only copy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key(column: str = "doc_id") -> Column:
    """doc_id as text, as the folds are defined on it; a null id counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(doc_key(column).cast("binary")), F.lit(parts)).cast("int")


def lookup(rows: DataFrame, table: DataFrame, key: str, size: str, n_rows: int, nulls: bool = True) -> DataFrame:
    """Left join of rows with table (one row a key; size: how many of rows have the key), whatever the skew. Keys that many
    rows have must be in the table; what it says of them can be null.

    Keys holding more than 1/HEAVY_SHARE of the rows number HEAVY_SHARE at most: their rows meet a broadcast table and
    are never shuffled. Rows without a key meet nothing. Only the rest goes through a shuffled join, in which no key of
    the table is hot. rows and table are read more than once, so they should be written tables or cheap to make.
    nulls=False vouches that every row has a key.
    """
    heavy = F.col(size) * HEAVY_SHARE > n_rows
    values = [c for c in table.columns if c != key]
    hot = table.filter(heavy)
    taken = [F.col(c) for c in rows.columns] + [F.col(c) for c in values]
    with_hot = rows.join(F.broadcast(hot), key).select(*taken)
    cold = (rows.filter(F.col(key).isNotNull()) if nulls else rows).join(F.broadcast(hot.select(key)), key, "left_anti")
    with_cold = cold.join(table.filter(~heavy), key, "left").select(*taken)
    if not nulls:
        return with_hot.unionByName(with_cold)
    none = rows.filter(F.col(key).isNull()).select(*[F.col(c) for c in rows.columns], *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in values])
    return with_hot.unionByName(with_cold).unionByName(none)

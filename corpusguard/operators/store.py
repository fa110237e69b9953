"""State kept between runs: remembered checks, the log of decisions, folders that moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns that must all be the same for a remembered check to hold; nulls are equal to nulls.
VALIDITY = ["text_sha256", "mode", "ocr", "version", "revision", "path", "stamp", "conf"]


def cache_hits(files: DataFrame, checks: DataFrame, key: str = "file") -> DataFrame:
    """key, hit: whether a check of the file under the same conditions is remembered."""
    names = [c for c in VALIDITY if c in files.columns and c in checks.columns]
    kept = checks.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in names]).distinct()
    same = F.col(key) == F.col("_k")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return files.join(kept, same, "left").select(key, F.col("_k").isNotNull().alias("hit"))


def latest(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key by time, then by a tie-breaker: an aggregate of one row a key, combined before the shuffle."""
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def moved_folders(known: DataFrame, present: DataFrame, least: float = 0.8) -> DataFrame:
    """old, new, share: known folders (folder, name, file) that are gone and whose files a present folder mostly has; the
    same name counts 0.01 more; the best new folder wins. Folders meet by file name."""
    sizes = known.groupBy("folder").agg(F.countDistinct("file").alias("n"), F.first("name").alias("old_name"))
    gone = sizes.join(present.select("folder").distinct(), "folder", "left_anti")
    met = known.join(present.select(F.col("folder").alias("new"), F.col("name").alias("new_name"), "file"), "file").groupBy("folder", "new", "new_name").agg(F.countDistinct("file").alias("m"))
    rows = met.join(gone, "folder").withColumn("share", F.col("m").cast("double") / F.col("n") + F.when(F.col("new_name") == F.col("old_name"), 0.01).otherwise(0.0))
    best = rows.filter(F.col("m").cast("double") / F.col("n") >= least).withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("share"), "new")))
    return best.filter("r = 1").select(F.col("folder").alias("old"), "new", "share")

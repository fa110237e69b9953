"""From findings to verdicts, under the categories a reviewer looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scoring import worst

#: Kinds of each category, and whether it is on from the start.
CATEGORIES = {
    "invented": ("invented_text not_in_scan scan_mismatch invented_words inserted_block rewritten unexpected_words", True),
    "numbers": ("invented_numbers", True),
    "tables": ("unfound_table degenerate_table", True),
    "repeated": ("duplicated_words repetition_loop", True),
    "scrambled": ("scrambled_text letter_spacing mixed_scripts control_characters", True),
    "sideways": ("sideways_page", True),
    "scan": ("scan_unchecked ocr_confidence no_text_layer model_pages poor_text_layer", True),
    "encoding": ("garbled_characters", False),
    "spelling": ("spelling_variants minor_drift", False),
    "missing": ("missing_from_text missing_block dropped_words retention", False),
}


def categories(spark: SparkSession) -> DataFrame:
    """category, kind, default_on: a fixed table of about 30 rows."""
    return spark.createDataFrame([(c, k, on) for c, (kinds, on) in CATEGORIES.items() for k in kinds.split()], "category string, kind string, default_on boolean")


def hidden_kinds(spark: SparkSession, on: list[str] | None = None) -> DataFrame:
    """kind: those of categories that are off; a kind of no category is never hidden."""
    table = categories(spark)
    return table.filter(~F.col("category").isin(on) if on is not None else ~F.col("default_on")).select("kind")


def visible(found: DataFrame, hidden: DataFrame) -> DataFrame:
    return found.join(F.broadcast(hidden), "kind", "left_anti")


def verdicts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, verdict, kinds of the documents with findings: reject if one is high, else review."""
    rows = found.groupBy(key).agg(F.max(worst(F.col("severity"))).alias("w"), F.array_sort(F.collect_set("kind")).alias("k"))
    return rows.select(key, F.when(F.col("w") == 3, "reject").otherwise("review").alias("verdict"), F.array_join("k", ", ").alias("kinds"))


def all_verdicts(docs: DataFrame, found: DataFrame, hidden: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, verdict, kinds of every document: ok without (visible) findings."""
    seen = visible(found, hidden) if hidden is not None else found
    return docs.select(key).join(verdicts(seen, key), key, "left").select(key, F.coalesce("verdict", F.lit("ok")).alias("verdict"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def recorded_verdicts(records: DataFrame, found: DataFrame, hidden: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, verdict: the recorded one (key, recorded), unless one of the findings behind it is hidden; then that of the rest."""
    touched = found.join(F.broadcast(hidden), "kind", "left_semi").select(key).distinct().withColumn("touched", F.lit(True))
    rest = verdicts(visible(found, hidden), key).select(key, F.col("verdict").alias("rest"))
    rows = records.join(touched, key, "left").join(rest, key, "left")
    return rows.select(key, F.when(F.col("touched"), F.coalesce("rest", F.lit("ok"))).otherwise(F.col("recorded")).alias("verdict"))


def worst_by_kind(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, severity: the worst of each kind."""
    return found.groupBy(key, "kind").agg(F.max_by("severity", worst(F.col("severity"))).alias("severity"))

"""Robust baselines of a corpus, risk scores against them, and the triage of documents."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight and direction of each metric, limits that trip alone, severities.
SPEC = {
    "script_mix_ratio": (1.4, 1), "vowelless_ratio": (1.0, 1), "gzip_ratio": (1.2, 0), "chars_per_page": (1.2, 0), "top_ngram_coverage": (1.6, 1), "tail_ngram_coverage": (1.6, 1),
    "dup_line_run": (1.0, 1), "junk_char_rate": (0.8, 1), "mojibake_rate": (0.8, 1), "short_token_run": (0.8, 1), "mean_token_len": (0.6, 0),
}
CLIP, LEAST_ROWS, REVIEW_PERCENTILE = 6.0, 20, 95.0


def unpivoted(metrics: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, metric, value: a row for each metric that is there."""
    names = [c for c in metrics.columns if c in SPEC]
    return metrics.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(key, "m.metric", "m.value").filter("value is not null")


def baseline(values: DataFrame) -> DataFrame:
    """metric, median, mad, n from (metric, value): one row a metric, so a dozen in all.

    The scale is the median absolute deviation, or the quartile distance / 1.35, or (99th percentile - median) / 2.33: the
    first that is positive; a metric with none, or fewer than LEAST_ROWS values, has no baseline. Quartiles are those at
    a quarter and three quarters of the sorted list. Values are first counted, so what a metric's task sorts is its
    distinct values.
    """
    counted = values.groupBy("metric", "value").agg(F.count("*").alias("n"))
    first = counted.groupBy("metric").agg(F.expr("percentile(value, 0.5, n)").alias("median"), F.sum("n").alias("n"), F.expr("percentile(value, 0.99, n)").alias("p99"))
    ranked = counted.join(F.broadcast(first.select("metric", "median", F.col("n").alias("all"))), "metric")
    upto = F.expr("sum(n) over (partition by metric order by value)")
    spread = ranked.withColumn("upto", upto).withColumns({"low": F.floor(F.col("all") / 4), "high": F.floor(3 * F.col("all") / 4)})
    scales = spread.groupBy("metric").agg(
        F.expr("percentile(abs(value - median), 0.5, n)").alias("mad"),
        (F.min(F.when(F.col("upto") > F.col("high"), F.col("value"))) - F.min(F.when(F.col("upto") > F.col("low"), F.col("value")))).alias("iqr"),
    )
    out = first.filter(F.col("n") >= LEAST_ROWS).join(scales, "metric")
    scale = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("iqr") > 0, F.col("iqr") / 1.35).when(F.col("p99") > F.col("median"), (F.col("p99") - F.col("median")) / 2.33)
    return out.select("metric", "median", scale.alias("mad"), "n").filter("mad is not null")


def scored(values: DataFrame, base: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, risk_score, n_metrics_used, risk_reasons: clipped robust z-scores, averaged by weight over the metrics that are there."""
    spec = values.sparkSession.createDataFrame([(m, w, d) for m, (w, d) in SPEC.items()], "metric string, weight double, direction int")
    rows = values.join(F.broadcast(base.select("metric", "median", "mad")), "metric").join(F.broadcast(spec), "metric")
    z = F.lit(0.6745) * (F.col("value") - F.col("median")) / F.col("mad")
    z = F.least(F.lit(CLIP), F.greatest(F.lit(0.0), F.when(F.col("direction") == 0, F.abs(z)).otherwise(z)))
    rows = rows.withColumn("z", z)
    reason = F.when(F.col("z") >= 3.0, F.struct((-F.round(F.col("weight") * F.col("z"), 3)).alias("o"), F.col("metric").alias("metric")))
    out = rows.groupBy(key).agg(F.sum(F.col("weight") * F.col("z")).alias("s"), F.sum("weight").alias("w"), F.count("*").alias("n_metrics_used"), F.array_sort(F.collect_list(reason)).alias("r"))
    return out.select(key, F.round(F.col("s") / F.col("w"), 4).alias("risk_score"), "n_metrics_used", F.array_join(F.transform(F.slice("r", 1, 4), lambda x: x["metric"]), "; ").alias("risk_reasons"))


def audit(metrics: DataFrame, scrambled: DataFrame | None = None, errors: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, too_short, risk_score, verdict: the worst REVIEW_PERCENTILE of scores go to review, scrambled texts (key, n_scrambled) too.

    errors (key, error): documents that could not be read; each has a row with the verdict error, and counts in no baseline.
    """
    # the metrics are read three times (baseline, scores, result): they are kept, one narrow row a document, so texts are read once
    metrics = kept(metrics)
    if errors is not None:
        metrics = metrics.join(errors.select(key), key, "left_anti")
    values = unpivoted(metrics.filter(~F.col("too_short")), key)
    scores = scored(values, baseline(values), key)
    bar = scores.agg(F.expr(f"percentile(risk_score, {REVIEW_PERCENTILE / 100})").alias("bar"))
    rows = metrics.select(key, "too_short").join(scores, key, "left").crossJoin(F.broadcast(bar))  # one row
    if scrambled is not None:
        rows = rows.join(scrambled.select(key, "n_scrambled"), key, "left")
    else:
        rows = rows.withColumn("n_scrambled", F.lit(0))
    verdict = F.when(F.col("too_short"), "too_short").when(F.coalesce("n_scrambled", F.lit(0)) >= 2, "scrambled").when(F.col("risk_score") >= F.coalesce("bar", F.lit(float("inf"))), "review").otherwise("ok")
    out = rows.select(key, "too_short", "risk_score", "n_metrics_used", "risk_reasons", verdict.alias("verdict"))
    if errors is None:
        return out
    return out.unionByName(errors.select(key, F.lit("error").alias("verdict")), allowMissingColumns=True)


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once: written to the folder in spark.checkpoint.dir where the session names one, and deleted when the
    driver ends; without one (a single machine) persisted, until the caller clears the session's cache."""
    spark = rows.sparkSession
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        return rows.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{place.rstrip('/')}/corpusguard-rows-{uuid.uuid4().hex[:12]}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def worst(severity: Column) -> Column:
    """Rank of a severity, 3 the worst."""
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)

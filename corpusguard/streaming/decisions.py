"""Streams: the log of decisions, kept as the latest of each file, and texts triaged as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect, store, verdicts

LOG = "file string, verdict string, reviewer string, note string, at_utc string, seq long"


def decision_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LOG).json(folder)


def keep_latest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Upsert the latest decision of each file into a Parquet table. Each batch writes a new version of it beside the old
    one and then a pointer's row; a batch that is run again writes the same version, so nothing counts twice."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_latest(spark, table, below=number)
        rows = batch if old is None else batch.unionByName(old)
        store.latest(rows, "file", "at_utc", "seq").write.mode("overwrite").parquet(f"{table}/version={number:012d}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """The newest version of the table (before a batch number), None if there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in files.listStatus(path))
    names = [n for n in names if n.startswith("version=") and (below is None or int(n[8:]) < below) and files.exists(jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))]
    return spark.read.schema(LOG).parquet(f"{table}/{names[-1]}") if names else None


def triage_stream(texts: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Verdicts of texts (file, text) as they arrive; the checkpoint remembers which were judged."""

    def judge(batch: DataFrame, number: int) -> None:
        found = detect.quick_findings(batch, "file", "text")
        verdicts.all_verdicts(batch, found, key="file").write.mode("overwrite").parquet(f"{sink}/batch={number:012d}")

    return texts.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", at: str = "ts") -> DataFrame:
    """key, start, end, n of sessions, batch or stream; events later than `late` are left out."""
    windowed = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour", at: str = "ts", kind: str = "event_type") -> DataFrame:
    """kind, start, n in windows of one width, batch or stream."""
    windowed = events.withWatermark(at, late).groupBy(kind, F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return windowed.select(kind, F.col("w.start").alias("start"), "n")


def run_to_end(start: Callable[[], StreamingQuery]) -> None:
    q = start()
    q.awaitTermination()

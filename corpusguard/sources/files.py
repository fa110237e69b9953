"""Sources and sinks: folders of text files, CSV and JSON results, adapters for parsers that are not part of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.repair import nfc

CSV_COLUMNS = ["file", "made_by", "tool_verdict", "checked_against", "problems", "decision", "reviewer", "note", "decided_at"]


@F.pandas_udf(StringType())
def decode_tolerantly(content: pd.Series) -> pd.Series:
    """UTF-8, else Windows-1252, else Latin-1. A byte-order mark stays in the text."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8", "cp1252"):
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("latin-1")

    return content.map(one)


def canonical_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def targets(spark: SparkSession, inputs: list[str], suffix: str = ".pdf", recursive: bool = False) -> DataFrame:
    """path of the files that inputs name: of a folder those with the suffix (whatever its case), in order; a file that has
    the suffix itself, whether it is there or not. Each once, in the order of the inputs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for n, name in enumerate(inputs):
        path = jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(conf)
        if files.exists(path) and files.getFileStatus(path).isDirectory():
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(name).select("path").filter(F.lower("path").endswith(suffix))
        elif name.lower().endswith(suffix):
            listed = spark.createDataFrame([(name,)], "path string")
        else:
            continue
        listed = listed.withColumn("n", F.lit(n))
        out = listed if out is None else out.unionByName(listed)
    if out is None:
        return spark.createDataFrame([], "path string")
    return out.groupBy("path").agg(F.min("n").alias("n")).orderBy("n", "path").select("path")


def find_sources(texts: DataFrame, present: DataFrame) -> DataFrame:
    """texts (path, recorded: where its source was) with source: the first that is there (present: path) of the recorded place,
    the same name beside the text, in the folder above, and in its folder pdf."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    name, folder = F.element_at(F.split(stem, "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    above = F.regexp_replace(folder, "/[^/]*$", "")
    named = F.concat(F.coalesce(F.regexp_extract("recorded", "[^/]+$", 0), F.concat(name, F.lit(".pdf"))))
    places = F.array(F.struct(F.lit(0).alias("n"), F.col("recorded").alias("at")), *[F.struct(F.lit(k + 1).alias("n"), F.concat(at, F.lit("/"), named).alias("at")) for k, at in enumerate((folder, above, F.concat(folder, F.lit("/pdf"))))])
    asked = texts.select("path", F.explode(places).alias("p")).select("path", "p.*").filter("at is not null")
    found = asked.join(present.select(F.col("path").alias("at")).distinct(), "at").groupBy("path").agg(F.min_by("at", "n").alias("source"))
    return texts.join(found, "path", "left")


def read_texts(spark: SparkSession, folder: str, glob: str = "*.txt", recursive: bool = True, limit: int | None = None) -> DataFrame:
    """path, file, text, sha256, stamp of the text files of a folder. Valid UTF-8 is decoded in the JVM; only the rest goes through Python."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if limit is not None:
        raw = raw.orderBy("path").limit(limit)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    rows = raw.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("stamp"), valid.alias("_ok"))
    good = rows.filter("_ok").withColumn("text", F.col("content").cast("string"))
    odd = rows.filter(~F.coalesce(F.col("_ok"), F.lit(False))).withColumn("text", decode_tolerantly("content"))
    return good.unionByName(odd).select("path", "file", canonical_newlines(F.col("text")).alias("text"), F.sha2("content", 256).alias("sha256"), "stamp")


def read_parsed(spark: SparkSession, folder: str, parser: Callable[[bytes], Iterator[dict]], schema: str, glob: str = "*.pdf") -> DataFrame:
    """Rows that a parser makes of each binary file: path and the columns of schema; a file that fails gives one row with error.

    The parser (of PDF files, of scans) is the caller's; nothing here reads such files.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    names = [c.split()[0] for c in schema.split(",")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = pd.DataFrame(list(parser(bytes(content))), columns=names)
                    error = None
                except Exception as e:  # one bad file must not end the batch
                    rows, error = pd.DataFrame([{}], columns=names), str(e)[:500]
                yield rows.assign(path=path, error=error)[["path", *names, "error"]]

    return raw.mapInPandas(parse, f"path string, {schema}, error string")


def match_sources(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """texts (file) with the source (path, priority) of the same name without its ending, composed and whatever its case; the first by priority, then path."""
    stem = lambda c: T.casefold(nfc(F.regexp_replace(c, r"\.[^.]*$", "")))
    named = sources.select("path", "priority", stem(F.element_at(F.split("path", "/"), -1)).alias("stem"))
    best = named.groupBy("stem").agg(F.min_by("path", F.struct("priority", "path")).alias("source"))
    return texts.withColumn("stem", stem(F.col("file"))).join(best, "stem", "left").drop("stem")


#: What the tables of an audit lead with; other columns follow.
LEAD = ["file", "doc_id", "verdict", "risk_score", "n_metrics_used", "risk_reasons", "error"]


def write_audit_csv(rows: DataFrame, path: str, score: str = "risk_score", *others: DataFrame) -> None:
    """Worst first, documents without a score last; Spark sorts by range, so the parts are in order. Rows of others (error
    rows, rows with more columns) go in too: the columns are all that there are, LEAD first."""
    for more in others:
        rows = rows.unionByName(more, allowMissingColumns=True)
    names = [c for c in LEAD if c in rows.columns]
    ordered = rows.select(*names, *[c for c in rows.columns if c not in names]).orderBy(F.col(score).desc_nulls_last())
    _write_csv(ordered, path)


def _write_csv(rows: DataFrame, path: str) -> None:
    """CSV parts with a header that begins with a byte-order mark, as spreadsheets expect UTF-8 to."""
    first, rest = rows.columns[0], rows.columns[1:]
    rows.select(F.col(first).alias(f"\ufeff{first}"), *rest).write.option("header", True).mode("overwrite").csv(path)


def write_texts(rows: DataFrame, folder: str, name: str = "file", text: str = "text") -> DataFrame:
    """Write each row's text as a file of its own in a folder (UTF-8, no byte-order mark, one newline at the end): file and
    error, null where it was written. A file that can't be written doesn't end the batch."""
    from pyarrow import fs

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            errors = []
            for file, body in zip(batch["file"], batch["text"], strict=True):
                try:
                    with files.open_output_stream(f"{root}/{file}") as out:
                        out.write(((body or "").rstrip("\n") + "\n").encode("utf-8"))
                    errors.append(None)
                except Exception as e:
                    errors.append(str(e)[:500])
            yield pd.DataFrame({"file": batch["file"], "error": pd.Series(errors, dtype=object)})

    return rows.select(F.col(name).alias("file"), F.col(text).alias("text")).mapInPandas(write, "file string, error string")


def write_summary_csv(rows: DataFrame, path: str) -> None:
    out = rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in CSV_COLUMNS])
    _write_csv(out, path)


def write_records(rows: DataFrame, path: str) -> None:
    """One JSON record a row, nulls left out."""
    rows.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records by an explicit schema; a corrupt one becomes a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_baseline(base: DataFrame, path: str) -> None:
    base.coalesce(1).write.mode("overwrite").json(path)  # a dozen rows


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """None where no baseline was written."""
    try:
        return spark.read.schema("metric string, median double, mad double, n long").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def numbered(rows: DataFrame, key: str = "path") -> DataFrame:
    """rows with n, the place by key within its folder."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(F.regexp_replace(key, "/[^/]*$", "")).orderBy(key)))

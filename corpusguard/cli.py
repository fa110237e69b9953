"""Command line: audit, check, vocabulary and summary of folders or Parquet tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings
from .operators import check, detect, lexicon, markup, metrics, report, scoring, verdicts
from .sources import files

COMMANDS = ("audit", "check", "vocabulary", "summary", "convert", "compare", "relist")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of a Parquet table, or of the text files of a folder (their names as ids)."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("doc_id", "text")
    return files.read_texts(spark, path).select(F.col("file").alias("doc_id"), "text")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusguard", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, words in [("audit", "rank documents by risk"), ("check", "verdicts from the text alone"), ("vocabulary", "words and the documents that have them"), ("summary", "counts of verdicts and decisions"), ("convert", "write plain texts"), ("compare", "hold texts against their sources (a table with text and source)"), ("relist", "verdicts that earlier checks recorded")]:
        one = commands.add_parser(name, help=words)
        one.add_argument("input")
        one.add_argument("-o", "--output", dest="output", required=name in ("audit", "vocabulary", "convert"))
    commands.choices["vocabulary"].add_argument("--min-documents", type=int, default=1)
    for name in ("check", "relist"):
        commands.choices[name].add_argument("--quiet", action="store_true", help="leave out documents that are ok")
    commands.choices["summary"].add_argument("--decisions", help="JSON records of doc_id, decision, reviewer")
    return out


def shown_all(rows: DataFrame) -> None:
    """Every row as a line of JSON, fetched part by part: the driver holds one part at a time."""
    for line in rows.toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: something needs review; 2: wrong use."""
    try:
        given = list(sys.argv[1:] if argv is None else argv)
        if given and not given[0].startswith("-") and given[0] not in COMMANDS:
            given.insert(0, "check")  # a bare path
        chosen, _, given = settings.parsed(given)
        args = parser().parse_args(given)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.appName("corpusguard").getOrCreate()
    try:
        return _run(spark, args, chosen)
    except KeyboardInterrupt:
        return 130


def _run(spark: SparkSession, args: argparse.Namespace, options: settings.Options) -> int:
    if args.command == "relist":
        # what earlier checks recorded, not a new assessment
        rows = files.read_records(spark, args.input, "doc_id string, verdict string, kinds string").filter("verdict is not null")
        shown = rows.filter("verdict <> 'ok'") if args.quiet else rows
        shown.write.mode("overwrite").json(args.output) if args.output else shown_all(shown)
        return 1 if rows.filter("verdict <> 'ok'").limit(1).count() else 0
    docs = documents(spark, args.input)
    if args.command == "convert":
        made = files.write_texts(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), markup.strip_markdown(F.col("text"), options.strip_strikethrough).alias("text")), args.output)
        failed = made.filter("error is not null").count()
        return 1 if failed else 0
    if args.command == "compare":
        pairs = spark.read.parquet(args.input).select("doc_id", "text", "source", *[F.lit(v).alias(c) for c, v in (("recognised", False), ("conf", 100.0))])
        judged = verdicts.all_verdicts(pairs, check.check(pairs))
        judged.write.mode("overwrite").json(args.output) if args.output else shown_all(judged)
        return 1 if judged.filter("verdict <> 'ok'").limit(1).count() else 0
    if args.command == "audit":
        files.write_audit_csv(scoring.audit(metrics.text_metrics(docs), detect.scramble_scan(docs)), args.output)
        return 0
    if args.command == "vocabulary":
        lexicon.vocabulary(docs, args.min_documents).write.mode("overwrite").parquet(args.output)
        return 0
    judged = verdicts.all_verdicts(docs, detect.quick_findings(docs))
    if args.command == "check":
        shown = judged.filter("verdict <> 'ok'") if args.quiet else judged
        shown.write.mode("overwrite").json(args.output) if args.output else shown_all(shown)
        return 1 if judged.filter("verdict <> 'ok'").limit(1).count() else 0
    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    decided = spark.read.schema(f"{key}, decision string, reviewer string").json(args.decisions) if args.decisions else spark.createDataFrame([], f"{key}, decision string, reviewer string")
    counts = report.summary_counts(report.summary(docs, judged, judged, decided))
    counts.write.mode("overwrite").json(args.output) if args.output else shown_all(counts.orderBy("what", F.desc("n")))
    return 0


if __name__ == "__main__":
    sys.exit(main())

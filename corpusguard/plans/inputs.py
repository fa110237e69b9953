"""Inputs that queries derive from the driver's tables, each as a DataFrame and as the same rows in SQL.

The fidelity operators compare a text with its source, and the layout operators need geometry; the tables have neither.
So texts are damaged, and lines and words placed on pages, by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables

INSERTED = "Zebra quixotic vexing jumbled wordings follow here plainly and 4711 of 1999-12-31 too"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (damaged), source. By doc_id % 5: sound, every 7th line dropped, line 2 doubled, a sentence added, "the" misspelt."""
    lines = F.split("text", "\n")
    dropped = F.array_join(F.filter(lines, lambda x, i: i % 7 != 6), "\n")
    doubled = F.concat(F.array_join(F.slice(lines, 1, 2), "\n"), F.lit("\n"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n"))
    added = F.concat("text", F.lit("\n" + INSERTED))
    kind = F.pmod(F.col("doc_id"), F.lit(5))
    damaged = F.when(kind == 1, dropped).when((kind == 2) & (F.size(lines) >= 2), doubled).when(kind == 3, added).when(kind == 4, F.replace("text", F.lit(" the "), F.lit(" thqe "))).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", damaged.alias("text"), F.col("text").alias("source"))


PAIRS = rf"""pairs AS (SELECT doc_id, text AS source, CASE
  WHEN doc_id % 5 = 1 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 7 <> 0), chr(10))
  WHEN doc_id % 5 = 2 AND len(string_split(text, chr(10))) >= 2 THEN array_to_string(list_concat(string_split(text, chr(10))[1:2], string_split(text, chr(10))[2:]), chr(10))
  WHEN doc_id % 5 = 3 THEN text || chr(10) || '{INSERTED}'
  WHEN doc_id % 5 = 4 THEN replace(text, ' the ', ' thqe ') ELSE text END AS text FROM documents)"""


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents on pages of eight, with a running header and a page number on each page."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    n = F.col("n")
    body = rows.select(
        "doc_id", (F.floor(n / 8) + 1).alias("page"), (n * 3 + 1).cast("long").alias("line"), "text", F.when(n % 6 == 5, 90.0).otherwise(72.0).alias("x0"),
        F.least(F.lit(540.0), 72.0 + 5.0 * F.length("text")).alias("x1"), (40.0 + 13.0 * (n % 8)).alias("top"), (50.0 + 13.0 * (n % 8)).alias("bottom"),
        F.when(n % 17 == 0, 12.0).when(n % 19 == 18, 8.0).otherwise(10.0).alias("size"), (n % 23 == 0).alias("bold"), F.lit(200.0).alias("page_height"),
    )
    pages = body.groupBy("doc_id", "page").agg(F.min("line").alias("f"), F.max("line").alias("l"))
    extra = lambda text, line, top: pages.select(
        "doc_id", "page", line.cast("long").alias("line"), text.alias("text"), F.lit(72.0).alias("x0"), (72.0 + 5.0 * F.length(text)).alias("x1"), F.lit(top).alias("top"), F.lit(top + 10.0).alias("bottom"), F.lit(9.0).alias("size"), F.lit(False).alias("bold"), F.lit(200.0).alias("page_height")
    )
    number = F.col("page").cast("string")
    head = extra(F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(", part "), number), F.col("f") - 1, 5.0)
    return body.unionByName(head).unionByName(extra(F.concat(F.lit("- "), number, F.lit(" -")), F.col("l") + 1, 185.0))


LAYOUT = """raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
body AS (SELECT doc_id, n // 8 + 1 AS page, n * 3 + 1 AS line, text, CASE WHEN n % 6 = 5 THEN 90.0::DOUBLE ELSE 72.0::DOUBLE END AS x0,
  least(540.0::DOUBLE, 72.0::DOUBLE + 5.0::DOUBLE * length(text)) AS x1, 40.0::DOUBLE + 13.0::DOUBLE * (n % 8) AS top, 50.0::DOUBLE + 13.0::DOUBLE * (n % 8) AS bottom,
  CASE WHEN n % 17 = 0 THEN 12.0::DOUBLE WHEN n % 19 = 18 THEN 8.0::DOUBLE ELSE 10.0::DOUBLE END AS size, n % 23 = 0 AS bold, 200.0::DOUBLE AS page_height FROM raw),
pgs AS (SELECT doc_id, page, min(line) AS f, max(line) AS l FROM body GROUP BY ALL),
layout AS (SELECT * FROM body UNION ALL
  SELECT doc_id, page, f - 1, 'Report ' || doc_id || ', part ' || page, 72.0, 72.0 + 5.0 * length('Report ' || doc_id || ', part ' || page), 5.0, 15.0, 9.0, false, 200.0 FROM pgs UNION ALL
  SELECT doc_id, page, l + 1, '- ' || page || ' -', 72.0, 72.0 + 5.0 * length('- ' || page || ' -'), 185.0, 195.0, 9.0, false, 200.0 FROM pgs)"""


def layout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in rows of eight, twenty rows a page; documents divisible by three in two columns."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.filter(F.split(F.regexp_replace("text", "\n", " "), " "), lambda w: w != "")).alias("n", "w"))
    n = F.col("n")
    x0 = 72.0 + 40.0 * (n % 8) + F.when((F.col("doc_id") % 3 == 0) & (n % 8 >= 4), 60.0).otherwise(0.0)
    top = 72.0 + 13.0 * (F.floor(n / 8) % 20)
    return rows.select("doc_id", (F.floor(n / 160) + 1).alias("page"), n.cast("long").alias("word"), F.floor(n / 8).alias("row"), x0.alias("x0"), (x0 + 5.0 * F.least(F.length("w"), F.lit(7))).alias("x1"), top.alias("top"), (top + 10.0).alias("bottom"), F.col("w").alias("text"))


WORDS = """wraw AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '') AS l FROM documents)),
words AS (SELECT *, x0 + 5.0::DOUBLE * least(length(w), 7) AS x1 FROM (SELECT doc_id, n // 160 + 1 AS page, n AS word, n // 8 AS row, w,
  72.0::DOUBLE + 40.0::DOUBLE * (n % 8) + CASE WHEN doc_id % 3 = 0 AND n % 8 >= 4 THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END AS x0 FROM wraw))"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as decisions: good texts accepted, bad ones rejected, every 7th needs work."""
    labels = table(spark, sf_dir, "labels")
    decision = F.when(F.col("doc_id") % 7 == 0, "needs_work").when(F.col("quality") == 1, "accepted").otherwise("rejected")
    return labels.select("doc_id", decision.alias("decision"), F.concat(F.lit("reader "), (F.col("doc_id") % 4).cast("string")).alias("reviewer"))


DECISIONS = "decisions AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'needs_work' WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS decision, 'reader ' || (doc_id % 4) AS reviewer FROM labels)"


def fold_sql(x: str) -> str:
    return f"regexp_replace(translate(replace(lower({x}), 'ß', 'ss'), '{T.ACCENTED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def lines_sql(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '{T.LINE_BREAKS}', chr(10), 'g'), chr(10))"


def words_sql(x: str) -> str:
    return rf"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"


def cells_sql(x: str) -> str:
    return rf"list_filter(flatten(list_transform(list_filter(string_split_regex({x}, '[\t|\n]'), lambda c: c <> ''), lambda c: string_split_regex(c, ' {{2,}}'))), lambda c: regexp_matches(c, '\S'))"

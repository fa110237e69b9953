"""Findings of all checks put together: routing by what a text was compared with, demotion, and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scoring import worst

#: Scores that ask for review or rejection, confidences of a recogniser, coverage under which a scan is another text.
REVIEW_SCORE, REJECT_SCORE, CONFIDENT, TRUSTED, SAME_TEXT = 3.0, 6.0, 0.75, 0.70, 0.6


def gate(docs: DataFrame, found: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, verdict, n_findings, risk_score: reject for a high finding or a score of 6, review for any finding or a score of 3, else ok."""
    # a text that is scrambled by its words and by itself is so once
    scrambled = found.filter("kind = 'scrambled_text'").groupBy(key, "kind").agg(F.max_by("severity", worst(F.col("severity"))).alias("severity"))
    found = found.filter("kind <> 'scrambled_text'").select(key, "kind", "severity").unionByName(scrambled)
    counted = found.groupBy(key).agg(F.max(worst(F.col("severity"))).alias("w"), F.count("*").alias("n"))
    rows = docs.select(key).join(counted, key, "left").join(scores.select(key, "risk_score"), key, "left")
    score, w = F.coalesce("risk_score", F.lit(0.0)), F.coalesce("w", F.lit(0))
    verdict = F.when((w == 3) | (score >= REJECT_SCORE), "reject").when((w > 0) | (score >= REVIEW_SCORE), "review").otherwise("ok")
    return rows.select(key, verdict.alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"), "risk_score")


def recognition_findings(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, severity from pages (key, page, source, conf): pages read by a model, low mean confidence, no text layer at all."""
    by = pages.groupBy(key).agg(
        F.count_if(F.col("source") == "recognised_model").alias("model"), F.avg(F.when(F.col("source") != "extracted", F.col("conf"))).alias("conf"), F.count_if(F.col("source") == "extracted").alias("layer")
    )
    tests = [("model_pages", "high", F.col("model") > 0), ("ocr_confidence", "medium", F.col("conf") < CONFIDENT), ("no_text_layer", "high", F.col("layer") == 0)]
    made = F.array(*[F.when(t, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, t in tests])
    return by.select(key, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("f")).select(key, "f.kind", "f.severity")


def scan_route(coverage: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, route from coverage (key, n_letters, n_covered): a scan that covers under 60 % of the text is another document, and nothing else is compared."""
    share = F.col("n_covered").cast("double") / F.nullif(F.col("n_letters"), F.lit(0))
    return coverage.select(key, F.when(share < SAME_TEXT, "scan_mismatch").otherwise("compare").alias("route"))


def demoted(found: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """found (key, page, kind, severity) with one severity less on pages whose recognition isn't trusted (conf)."""
    poor = pages.filter(F.col("conf") < TRUSTED).select(key, "page", F.lit(True).alias("_poor"))
    rows = found.join(poor, [key, "page"], "left")
    lower = F.when(F.col("severity") == "high", "medium").otherwise("low")
    return rows.select(key, "page", "kind", F.when(F.col("_poor"), lower).otherwise(F.col("severity")).alias("severity"))


def sideways_pages(lines: DataFrame, limit: int = 60, key: str = "doc_id") -> DataFrame:
    """key, page, first_line, last_line of pages whose lines (key, page, line, upright) all stand sideways; the first `limit` of a document."""
    by = lines.groupBy(key, "page").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.max(F.col("upright").cast("int")).alias("u")).filter("u = 0")
    return by.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("page"))).filter(F.col("r") <= limit).select(key, "page", "first_line", "last_line")


def retention_stats(blocks: DataFrame, dropped: DataFrame, raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kept_ratio (1 at most), alnum_ratio: what blocks (text) and lines dropped on purpose (text) hold of the raw text."""
    size = lambda df, a, b: df.groupBy(key).agg(F.sum(F.length(T.squeeze(F.col("text")))).alias(a), F.sum(T.alnum_count(F.col("text"))).alias(b))
    rows = size(raw, "rc", "ra").join(size(blocks, "bc", "ba"), key, "left").join(size(dropped, "dc", "da"), key, "left")
    part = lambda a, b, c: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("double") / F.nullif(F.col(c), F.lit(0))
    return rows.select(key, F.least(F.lit(1.0), part("bc", "dc", "rc")).alias("kept_ratio"), part("ba", "da", "ra").alias("alnum_ratio"))


def decoded_glyphs(docs: DataFrame, raw: str, text: str, key: str = "doc_id") -> DataFrame:
    """key, code, letter: what the glyph codes (cid:N) of a raw layer stand for, voted by the words of the text.

    A raw word with codes meets the text's words by equality on (key, its decoded length, place and value of its first
    known letter) and then by its known letters; a word that fits exactly one votes for each of its codes. A letter wins
    with two votes and 80 % of them. Words of the text that no raw word can meet are dropped within their row.
    """
    pattern, coded = r"\(cid:\d+\)", r"(?<!\p{L})(?:\p{L}*+\(cid:\d+\))+\p{L}*"
    rows = docs.select(key, F.array_distinct(F.regexp_extract_all(raw, F.lit(coded), F.lit(0))).alias("ws"), F.array_distinct(T.tokens(F.col(text), r"\p{L}+")).alias("ts")).filter("size(ws) > 0")

    def sign(word: Column, place: Column) -> Column:
        """Length, place (0 if no letter is known) and letter."""
        return F.concat_ws(":", F.length(word), place, F.when(place > 0, F.substring(word, place, F.lit(1))).otherwise(""))

    shape = lambda w: F.regexp_replace(w, pattern, "\u0001")
    known_at = lambda s: F.when(s.rlike("[^\u0001]"), F.length(F.regexp_extract(s, "^\u0001*", 0)) + 1).otherwise(0)
    rows = rows.withColumn("shapes", F.transform("ws", shape)).withColumn("signs", F.array_distinct(F.transform("shapes", lambda s: sign(s, known_at(s))))).withColumn("places", F.array_distinct(F.transform("shapes", known_at)))
    words = rows.select(key, F.explode(F.arrays_zip("ws", "shapes")).alias("x")).select(key, F.col("x.ws").alias("w"), F.col("x.shapes").alias("shape"))
    marked = words.select(key, "w", F.regexp_extract_all("w", F.lit(pattern), F.lit(0)).alias("codes"), "shape", sign(F.col("shape"), known_at(F.col("shape"))).alias("sign"), F.length("shape").alias("n"))
    signed = F.flatten(F.transform("places", lambda p: F.transform("ts", lambda t: F.struct(sign(t, p).alias("sign"), t.alias("t")))))
    known = rows.select(key, F.explode(F.filter(signed, lambda x: F.array_contains("signs", x["sign"]))).alias("x")).select(key, "x.sign", "x.t")
    met = marked.join(known, [key, "sign"])
    fits = met.filter(F.expr("forall(sequence(1, n), i -> substr(shape, i, 1) = '\u0001' or substr(shape, i, 1) = substr(t, i, 1))"))
    one = fits.groupBy(key, "w", "shape", "codes").agg(F.count("*").alias("c"), F.first("t").alias("t")).filter("c = 1")
    places = F.filter(F.sequence(F.lit(1), F.length("shape")), lambda i: F.substring(F.col("shape"), i, F.lit(1)) == "\u0001")
    votes = one.select(key, F.explode(F.arrays_zip(F.col("codes").alias("code"), F.transform(places, lambda i: F.substring(F.col("t"), i, F.lit(1))).alias("letter"))).alias("v")).select(key, "v.code", "v.letter")
    counted = votes.groupBy(key, "code", "letter").agg(F.count("*").alias("n"))
    best = counted.groupBy(key, "code").agg(F.max_by("letter", F.struct("n", "letter")).alias("letter"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.filter("n >= 2 and n >= 0.8 * all").select(key, "code", "letter")

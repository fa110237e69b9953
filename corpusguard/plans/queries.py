"""Registered queries of the fidelity engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair
from ..functions import text as T
from ..operators import contain, detect, fidelity, gate, layout, lexicon, markup, metrics, profile, report, scoring, spans, store, verdicts
from . import inputs
from .oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register f; whole numbers come out as bigint, as SQL counts do."""

    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = f(spark, d)
        return out.select(*[F.col(c).cast("bigint").alias(c) if kind == "int" else c for c, kind in out.dtypes])

    QUERIES[f.__name__] = run
    return run


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else c for c, kind in df.dtypes])


# metrics, detectors, scores


@query
def audit_metrics(spark, d):
    return _rounded(metrics.text_metrics(inputs.documents(spark, d)))


@query
def audit_baseline(spark, d):
    m = scoring.kept(metrics.text_metrics(inputs.documents(spark, d)))
    return _rounded(scoring.baseline(scoring.unpivoted(m.filter("not too_short")).select("metric", "value")))


@query
def audit_scores(spark, d):
    values = scoring.unpivoted(scoring.kept(metrics.text_metrics(inputs.documents(spark, d))).filter("not too_short"))
    return scoring.scored(values, scoring.baseline(values)).select("doc_id", F.round("risk_score", 3).alias("risk_score"), "n_metrics_used")


@query
def audit_triage(spark, d):
    docs = inputs.documents(spark, d)
    rows = scoring.audit(metrics.text_metrics(docs), detect.scramble_scan(docs))
    return rows.select("doc_id", "too_short", F.round("risk_score", 3).alias("risk_score"), "verdict")


@query
def quick_triage(spark, d):
    docs = inputs.documents(spark, d)
    return verdicts.all_verdicts(docs, detect.quick_findings(docs))


@query
def gzip_ratio(spark, d):
    return inputs.documents(spark, d).select("doc_id", metrics.gzip_ratio("text").alias("gzip_ratio"))


@query
def prose_lines(spark, d):
    rows = inputs.documents(spark, d).select("doc_id", T.prose(F.col("text")).alias("p"), T.lines(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").alias("n_lines"), F.size("p").alias("n_prose"), F.length(F.array_join("p", "\n")).alias("n_chars"))


@query
def ngram_coverage(spark, d):
    return _rounded(metrics.text_metrics(inputs.documents(spark, d)).filter("not too_short").select("doc_id", "top_ngram_coverage", "tail_ngram_coverage"))


@query
def dup_line_run(spark, d):
    return _rounded(metrics.text_metrics(inputs.documents(spark, d)).filter("not too_short").select("doc_id", "dup_line_run"))


@query
def short_token_run(spark, d):
    return _rounded(metrics.text_metrics(inputs.documents(spark, d)).filter("not too_short").select("doc_id", "short_token_run"))


@query
def degenerate_table(spark, d):
    made = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\na | 17 | 17\n17 | 17 | 17\n17 | 17 | b\n17 | 17 | 17\n17 | 17 | 17\n17 | 17 | 17"))).otherwise(F.col("text"))
    return _rounded(detect.degenerate_tables(inputs.documents(spark, d).withColumn("text", made)))


@query
def scrambled(spark, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" aBcDeFgH tHeReFoRe Ordinary UPPERCASE"))).otherwise(F.col("text"))
    return detect.scramble_scan(inputs.documents(spark, d).withColumn("text", made))


@query
def control_chars(spark, d):
    made = F.when(F.col("doc_id") % 6 == 0, F.concat(F.substring("text", 1, 40), F.lit("\u0001�\u0002"), F.substring("text", 41, 1 << 30))).otherwise(F.col("text"))
    return _rounded(detect.control_characters(inputs.documents(spark, d).withColumn("text", made)))


@query
def repeated_line(spark, d):
    return detect.repeated_lines(inputs.documents(spark, d))


# text against source


@query
def invented_words(spark, d):
    return fidelity.invented_words(fidelity.balances(inputs.pairs(spark, d), "text", "source"))


@query
def lost_words(spark, d):
    return fidelity.lost_words(fidelity.balances(inputs.pairs(spark, d), "text", "source"))


@query
def hyphen_joins(spark, d):
    docs = inputs.documents(spark, d)
    made = docs.select("doc_id", F.regexp_replace("text", "([a-z]{3}) ([a-z]{3})", "$1$2").alias("text"), F.col("text").alias("source"))
    return fidelity.hyphen_joins(fidelity.balances(made, "text", "source"))


@query
def invented_numerals(spark, d):
    return fidelity.invented_numerals(inputs.pairs(spark, d), "text", "source")


@query
def retention(spark, d):
    return _rounded(fidelity.retention(inputs.pairs(spark, d), "text", "source"))


@query
def removed_words(spark, d):
    docs = inputs.documents(spark, d)
    removed = docs.select("doc_id", F.explode(F.array(F.lit("the"), F.lit("of"))).alias("word"), F.lit(2).alias("n"))
    return fidelity.without(fidelity.words_at(docs, "text"), removed).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("at").alias("places"))


@query
def shingle_coverage(spark, d):
    return contain.coverage(inputs.pairs(spark, d), "text", "source")


@query
def unmatched_runs(spark, d):
    return contain.unmatched(inputs.pairs(spark, d), "text", "source").drop("stop")


@query
def word_coverage(spark, d):
    return _rounded(contain.word_coverage(inputs.pairs(spark, d), "text", "source"))


@query
def invented_passages(spark, d):
    docs = inputs.pairs(spark, d)
    return contain.invented_passages(docs, contain.unmatched(docs, "text", "source"), "text")


@query
def repeated_passages(spark, d):
    return contain.repeated_passages(inputs.pairs(spark, d), "text", "source")


@query
def absent_numbers(spark, d):
    return contain.absent_numbers(inputs.pairs(spark, d), "text", "source")


@query
def unfound_rows(spark, d):
    made = inputs.pairs(spark, d).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nzyxw | vutsr | qqpp | a\nin | the | of"))).otherwise(F.col("text")))
    return contain.unfound_rows(made, "text", "source")


@query
def spelling_variants(spark, d):
    return contain.spelling_variants(inputs.pairs(spark, d), "text", "source")


@query
def missing_text(spark, d):
    return contain.missing_text(inputs.pairs(spark, d), "text", "source").drop("stop")


@query
def set_aside(spark, d):
    return contain.set_aside(inputs.layout_lines(spark, d).filter("text not like 'Report %' and text not like '- %'"))


# spans and anchors


@query
def anchors(spark, d):
    rows = spans.anchors(inputs.pairs(spark, d), "text", "source")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("at").alias("places"), F.sum("source_at").alias("source_places"))


@query
def line_pages(spark, d):
    rows = inputs.layout_lines(spark, d)
    votes = rows.filter("line % 4 <> 0").select("doc_id", (F.floor(F.col("line") / 5)).alias("line"), "page")
    return spans.line_pages(votes, rows.select("doc_id", F.floor(F.col("line") / 5).alias("line")).distinct())


@query
def finding_pages(spark, d):
    blocks = inputs.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text"))
    placed = spans.offsets(blocks, 1).filter("block % 3 <> 1").select("doc_id", (F.floor(F.col("block") / 8) + 1).alias("page"), "char_start", "char_end")
    points = inputs.documents(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(97))).alias("pos")).select("doc_id", F.col("pos").cast("long").alias("point_id"), F.col("pos").cast("long").alias("pos"))
    return spans.point_in_span(points, placed).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("page").alias("pages"), F.sum(F.col("pos") * F.coalesce("page", F.lit(0))).alias("mix"))


@query
def region_boxes(spark, d):
    lines = inputs.layout_lines(spark, d)
    placed = lines.select("doc_id", "page", (F.col("line") * 40).alias("char_start"), (F.col("line") * 40 + 38).alias("char_end"), "x0", "top", "x1", "bottom")
    ranges = inputs.documents(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(500))).alias("range_id")).select("doc_id", F.col("range_id").cast("long").alias("range_id"), F.col("range_id").cast("long").alias("a"), (F.col("range_id") + 130).cast("long").alias("b"))
    return spans.region_boxes(ranges, placed)


@query
def page_ranges(spark, d):
    return spans.page_ranges(inputs.layout_lines(spark, d).filter("page % 5 <> 3").select("doc_id", "page"))


@query
def block_offsets(spark, d):
    blocks = inputs.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text"))
    return spans.offsets(blocks).groupBy("doc_id").agg(F.max("char_end").alias("n"), F.sum("char_start").alias("starts"))


# layout


@query
def gutter(spark, d):
    return _rounded(layout.gutters(inputs.layout_words(spark, d)))


@query
def reading_order(spark, d):
    lines = inputs.layout_lines(spark, d)
    placed = lines.withColumn("col", F.when(F.col("line") % 7 == 0, -1).otherwise((F.col("line") % 2).cast("int")))
    return layout.reading_order(placed)


@query
def headings(spark, d):
    return layout.headings(inputs.layout_lines(spark, d)).filter("heading").select("doc_id", "page", "line")


@query
def line_breaks(spark, d):
    return layout.line_breaks(inputs.layout_lines(spark, d))


@query
def running_heads(spark, d):
    return layout.running_heads(inputs.layout_lines(spark, d))


@query
def stripped_heads(spark, d):
    lines = inputs.layout_lines(spark, d)
    return layout.strip_heads(lines, layout.running_heads(lines))


@query
def page_joins(spark, d):
    # blocks of thirty words are cut in the row: nothing is shuffled but what the operator orders
    rows = inputs.documents(spark, d).select("doc_id", F.explode(F.array(F.split("text", " "))).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 30).cast("int")), lambda b: F.array_join(F.slice("w", b * 30 + 1, F.lit(30)), " "))
    blocks = rows.filter("w is not null").select("doc_id", F.posexplode(cut).alias("block", "text"))
    blocks = blocks.select("doc_id", F.col("block").cast("long").alias("block"), (F.floor(F.col("block") / 2) + 1).alias("page"), "text", F.lit(False).alias("heading"))
    return layout.page_joins(blocks)


@query
def assembled(spark, d):
    blocks = inputs.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text"))
    return layout.assemble(blocks).select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))


@query
def words_outside_tables(spark, d):
    words = inputs.layout_words(spark, d)
    tables = words.select("doc_id", "page").distinct().filter("page % 2 = 1").select("doc_id", "page", F.lit(100.0).alias("x0"), F.lit(300.0).alias("x1"), F.lit(90.0).alias("top"), F.lit(160.0).alias("bottom"))
    return layout.words_in_tables(words, tables).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query
def visual_rows(spark, d):
    words = inputs.layout_words(spark, d).select("doc_id", "page", "word", "x0", "x1", "top", "bottom")
    return layout.group_rows(words).groupBy("doc_id", "page").agg(F.countDistinct("row").alias("rows"))


@query
def table_columns(spark, d):
    cells = inputs.layout_words(spark, d).select("doc_id", F.col("page").alias("seg"), "row", F.col("x0").alias("x"), F.col("word").cast("string").alias("text"))
    return layout.table_columns(cells).groupBy("doc_id", "seg", "row").agg(F.max("n_columns").alias("n_columns"), F.array_join(F.array_sort(F.collect_list("col")), " ").alias("cols"))


@query
def dominant_angles(spark, d):
    chars = inputs.layout_words(spark, d).select("doc_id", "page", F.when(F.col("page") % 3 == 0, 0.0).otherwise(1.0).alias("a"), F.when(F.col("page") % 3 == 0, 1.0).when(F.col("word") % 5 == 0, 1.0).otherwise(0.0).alias("b"))
    return layout.dominant_angle(chars)


# profile, recognition, mark-up


@query
def pdf_risk(spark, d):
    lines = inputs.layout_lines(spark, d)
    pages = lines.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("size") < 9).alias("small"), F.count_if(F.col("bold")).alias("rulings"), F.countDistinct("x0").alias("col_edges"))
    p = F.col("page")
    pages = pages.select("doc_id", F.when(p % 4 == 0, 0).otherwise(F.col("n_chars")).alias("n_chars"), "small", "rulings", "col_edges", F.when(p % 5 == 0, 800.0).otherwise(600.0).alias("width"), F.lit(700.0).alias("height"), (p % 6 == 0).alias("rotated"), F.when(F.col("doc_id") % 3 == 0, 150).otherwise(300).alias("dpi"))
    return _rounded(profile.risk(profile.page_signals(pages)).select("doc_id", "susceptibility", "geometry_risk", "recommended_check"))


@query
def lang_markers(spark, d):
    return _rounded(profile.languages(inputs.documents(spark, d), ["eng", "fra", "spa", "deu"]))


@query
def layer_judge(spark, d):
    pages = inputs.layout_lines(spark, d).groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("n"))
    pages = pages.select("doc_id", "page", (F.col("n") * 9).alias("confident"), F.when(F.col("doc_id") % 3 == 0, F.col("n")).when(F.col("doc_id") % 3 == 1, F.lit(1)).otherwise(F.lit(0)).alias("lacking"))
    return profile.layer_verdicts(pages)


@query
def ocr_mass(spark, d):
    words = inputs.layout_words(spark, d)
    passes = words.select("doc_id", "page", F.explode(F.array(F.lit(1), F.lit(2))).alias("pass"), "word")
    passes = passes.filter("pass = 1 or word % 4 <> 0").select("doc_id", "page", "pass", (F.lit(50.0) + (F.col("word") * 7 + F.col("doc_id") * F.col("pass")) % 50).alias("conf"))
    return profile.chosen_pass(passes)


@query
def needs_ocr(spark, d):
    pages = inputs.layout_lines(spark, d).groupBy("doc_id", "page").agg(F.sum(F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).alias("n_letters"))
    return profile.needs_recognition(pages).filter("needs_ocr").select("doc_id", "page", "n_letters")


@query
def strip_html(spark, d):
    return inputs.table(spark, d, "pages").select("page_id", markup.strip_html(F.col("html")).alias("text"))


@query
def markdown_blocks(spark, d):
    made = inputs.documents(spark, d).withColumn("text", F.concat(F.lit("# Title *of* it\n\n- one\n- **two**\n\n> quoted\n\n```\ncode\n```\n\n"), F.col("text")))
    return markup.markdown_blocks(made).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query
def alignment(spark, d):
    return inputs.pairs(spark, d).select("doc_id", repair.aligned("text", "source").alias("a")).select("doc_id", "a.*")


@query
def mojibake_repair(spark, d):
    made = inputs.documents(spark, d).select("doc_id", F.concat(F.lit("cafÃ© â€™s "), "text").alias("text"))
    return made.select("doc_id", F.sha2(repair.repaired("text"), 256).alias("digest"))


@query
def glyph_codes(spark, d):
    rows = inputs.documents(spark, d)
    made = rows.select("doc_id", "text", F.regexp_replace("text", "q", "(cid:17)").alias("raw"))
    return gate.decoded_glyphs(made, "raw", "text")


@query
def quality_gate(spark, d):
    docs, found = _findings(spark, d)
    scores = docs.select("doc_id", (F.col("doc_id") % 8).cast("double").alias("risk_score"))
    return gate.gate(docs, found, scores)


@query
def recognition_findings(spark, d):
    pages = inputs.layout_lines(spark, d).select("doc_id", "page").distinct()
    made = pages.select("doc_id", "page", F.when(F.col("doc_id") % 5 == 0, "extracted").when(F.col("page") % 4 == 0, "recognised_model").otherwise("recognised_tesseract").alias("source"), (0.6 + (F.col("doc_id") % 4) / 10).alias("conf"))
    return gate.recognition_findings(made)


@query
def scan_route(spark, d):
    rows = inputs.documents(spark, d).select("doc_id", F.length("text").cast("long").alias("n_letters"), (F.length("text") * (F.col("doc_id") % 10) / 10).cast("long").alias("n_covered"))
    return gate.scan_route(rows)


@query
def demoted(spark, d):
    pages = inputs.layout_lines(spark, d).select("doc_id", "page").distinct().withColumn("conf", F.when(F.col("page") % 2 == 0, 0.5).otherwise(0.9))
    found = pages.select("doc_id", "page", F.lit("not_in_scan").alias("kind"), F.when(F.col("doc_id") % 2 == 0, "high").otherwise("medium").alias("severity"))
    return gate.demoted(found, pages)


@query
def sideways_pages(spark, d):
    return gate.sideways_pages(inputs.layout_lines(spark, d).withColumn("upright", (F.col("page") % 3 != 0) & (F.col("line") % 2 == 0)))


@query
def retention_stats(spark, d):
    lines = inputs.layout_lines(spark, d)
    return _rounded(gate.retention_stats(lines.filter("line % 5 <> 0"), lines.filter("line % 10 = 0"), lines))


# lexicon, verdicts, state, summaries


@query
def vocabulary(spark, d):
    return lexicon.vocabulary(inputs.documents(spark, d))


@query
def suspicious(spark, d):
    docs = inputs.documents(spark, d)
    return lexicon.suspicious(docs, lexicon.vocabulary(docs, min_documents=2))


@query
def unexpected_words(spark, d):
    docs = inputs.documents(spark, d)
    return lexicon.findings(lexicon.suspicious(docs, lexicon.vocabulary(docs, min_documents=2)))


def _findings(spark, d):
    """Stand-in findings from labels and ids."""
    docs = inputs.documents(spark, d).select("doc_id")
    kinds = [("invented_words", "high", 9), ("dropped_words", "medium", 4), ("spelling_variants", "low", 3), ("repetition_loop", "high", 11), ("unheard_of", "medium", 13)]
    rows = [docs.filter(F.col("doc_id") % k == 0).select("doc_id", F.lit(kind).alias("kind"), F.lit(s).alias("severity")) for kind, s, k in kinds]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return docs, out


@query
def all_verdicts(spark, d):
    docs, found = _findings(spark, d)
    return verdicts.all_verdicts(docs, found)


@query
def visible_verdicts(spark, d):
    docs, found = _findings(spark, d)
    return verdicts.all_verdicts(docs, found, verdicts.hidden_kinds(spark))


@query
def hidden_verdicts(spark, d):
    docs, found = _findings(spark, d)
    records = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "reject").otherwise("ok").alias("recorded"))
    return verdicts.recorded_verdicts(records, found, verdicts.hidden_kinds(spark))


@query
def worst_by_kind(spark, d):
    _, found = _findings(spark, d)
    more = found.select("doc_id", "kind", F.when(F.col("doc_id") % 2 == 0, "medium").otherwise("low").alias("severity"))
    return verdicts.worst_by_kind(found.unionByName(more))


@query
def cache_hits(spark, d):
    docs = inputs.documents(spark, d)
    digest = F.sha2("text", 256)
    files = docs.select("doc_id", digest.alias("text_sha256"), F.lit(3).alias("revision"), F.when(F.col("doc_id") % 2 == 0, "auto").alias("ocr"))
    checks = docs.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(digest).alias("text_sha256"), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(3).alias("revision"), F.when(F.col("doc_id") % 2 == 0, "auto").alias("ocr"))
    return store.cache_hits(files, checks, "doc_id")


@query
def latest_decisions(spark, d):
    log = inputs.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return store.latest(log, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query
def moved_folders(spark, d):
    docs = inputs.table(spark, d, "documents")
    known = docs.select(F.concat(F.lit("old/"), "source").alias("folder"), F.col("source").alias("name"), F.col("doc_id").cast("string").alias("file"))
    present = docs.filter("doc_id % 9 <> 0 or source = 'src3'").select(F.concat(F.lit("new/"), "source").alias("folder"), F.col("source").alias("name"), F.col("doc_id").cast("string").alias("file"))
    return _rounded(store.moved_folders(known, present))


def _summary(spark, d):
    docs, found = _findings(spark, d)
    checks = verdicts.all_verdicts(docs.filter("doc_id % 3 <> 0"), found)
    triage = verdicts.all_verdicts(docs.filter("doc_id % 5 <> 0"), found.filter("severity <> 'low'"))
    return report.summary(docs, checks, triage, inputs.decisions(spark, d))


@query
def summary(spark, d):
    return _summary(spark, d)


@query
def summary_counts(spark, d):
    return report.summary_counts(_summary(spark, d))


@query
def review_queue(spark, d):
    return report.review_queue(_summary(spark, d), 100)


@query
def with_problem(spark, d):
    return report.with_problem(_summary(spark, d), "dropped_words").select("doc_id", "tool_verdict")


from . import checks as _checks  # noqa: E402, F401  these register their queries here
from . import pages as _pages  # noqa: E402, F401

"""Folder summaries and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import worst


def decision_rank(c: Column) -> Column:
    return F.when(c == "rejected", 0).when(c == "needs_work", 1).when(c == "accepted", 2).otherwise(3)


def verdict_rank(c: Column) -> Column:
    return F.when(c == "reject", 0).when(c == "review", 1).when(c == "unknown", 2).when(c == "ok", 3).otherwise(4)


def summary(files: DataFrame, checks: DataFrame, triage: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a file: verdict and problems of its check, else of its triage; its decision; and the place it is read in."""
    rows = files.select(key).join(checks.select(key, F.col("verdict").alias("cv"), F.col("kinds").alias("ck")), key, "left")
    rows = rows.join(triage.select(key, F.col("verdict").alias("tv"), F.col("kinds").alias("tk")), key, "left").join(decisions.select(key, "decision", "reviewer"), key, "left")
    out = rows.select(key, F.coalesce("cv", "tv", F.lit("")).alias("tool_verdict"), F.coalesce("ck", "tk", F.lit("")).alias("problems"), F.coalesce("decision", F.lit("")).alias("decision"), F.coalesce("reviewer", F.lit("")).alias("reviewer"))
    return out.withColumns({"decision_rank": decision_rank(F.col("decision")), "verdict_rank": verdict_rank(F.col("tool_verdict"))})


def summary_counts(rows: DataFrame) -> DataFrame:
    """what, value, n: files, decided, overruled, and counts by decision, verdict, problem and reviewer.

    Each row gives its few (what, value) pairs at once and they are counted in one pass.
    """
    decided = F.col("decision") != ""
    pair = lambda what, value, test: F.when(test, F.struct(F.lit(what).alias("what"), value.alias("value")))
    none = F.lit("")
    pairs = F.array(
        pair("files", none, F.lit(True)), pair("decided", none, decided), pair("overruled", none, decided & ((F.col("tool_verdict") == "ok") != (F.col("decision") == "accepted"))),
        pair("by_decision", F.col("decision"), decided), pair("by_verdict", F.when(F.col("tool_verdict") == "", "unknown").otherwise(F.col("tool_verdict")), F.lit(True)), pair("reviewers", F.col("reviewer"), decided & (F.col("reviewer") != "")),
    )
    problems = F.transform(F.filter(F.split("problems", ", "), lambda p: p != ""), lambda p: F.struct(F.lit("by_problem").alias("what"), p.alias("value")))
    return rows.select(F.explode(F.concat(F.filter(pairs, lambda p: p.isNotNull()), problems)).alias("p")).groupBy("p.what", "p.value").agg(F.count("*").alias("n"))


def review_queue(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first n undecided files in the order they should be read: a top-k, not a sort."""
    return rows.filter("decision = ''").orderBy("verdict_rank", key).limit(n).select(key, "tool_verdict", "problems")


def with_problem(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.array_contains(F.split("problems", ", "), kind))


def checked_against(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, checked_against of records (key, reference, sources: of its pages): the reference, else model, recognised, text_layer or none by the pages' sources."""
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    by_pages = F.when(F.array_contains(sources, "recognised_model"), "model").when(F.array_contains(sources, "recognised_tesseract"), "recognised").when(F.size(sources) > 0, "text_layer").otherwise("none")
    return records.select(key, F.coalesce(F.nullif(F.col("reference"), F.lit("")), by_pages).alias("checked_against"))


def verdict_from_severities(severities: Column, hidden: list[str]) -> Column:
    """Verdict from a map of the worst severity of each kind: reject for a high one that is looked for, review for any, else ok."""
    shown = F.map_values(F.map_filter(severities, lambda k, _: ~k.isin(hidden)))
    return F.when(F.array_contains(shown, "high"), "reject").when(F.size(shown) > 0, "review").otherwise("ok")


def states(files: DataFrame, records: DataFrame, summaries: DataFrame, triage: DataFrame, hidden: list[str], key: str = "doc_id") -> DataFrame:
    """key, verdict, analysed, compared, problems of files (key, own: made with a record): what the list shows of each.

    From its record (key, recorded, severities, reference); else from what the last check left (key, recorded,
    severities, compared); else from the quick sort (key, severities). A recorded verdict stands unless a kind behind it
    is hidden; then it is that of the rest. A file that nothing is known of is unknown.
    """
    r = records.select(key, F.col("recorded").alias("_rv"), F.col("severities").alias("_rs"), F.col("reference").alias("_ref"), F.lit(True).alias("_r"))
    s = summaries.select(key, F.col("recorded").alias("_sv"), F.col("severities").alias("_ss"), F.col("compared").alias("_sc"), F.lit(True).alias("_s"))
    t = triage.select(key, F.col("severities").alias("_ts"), F.lit(True).alias("_t"))
    rows = files.select(key, "own").join(r, key, "left").join(s, key, "left").join(t, key, "left")
    touched = lambda m: F.exists(F.map_keys(m), lambda k: k.isin(hidden))
    shown = lambda verdict, m: F.when(F.col(verdict).isNotNull() & ~F.coalesce(touched(F.col(m)), F.lit(False)), F.col(verdict)).otherwise(verdict_from_severities(F.col(m), hidden))
    verdict = F.when(F.col("_r"), shown("_rv", "_rs")).when(F.col("_s"), shown("_sv", "_ss")).when(F.col("_t"), verdict_from_severities(F.col("_ts"), hidden)).otherwise("unknown")
    kinds = F.when(F.col("_r"), F.map_keys("_rs")).when(F.col("_s"), F.map_keys("_ss")).otherwise(F.map_keys("_ts"))
    problems = F.array_join(F.array_sort(F.filter(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: (k != "") & ~k.isin(hidden))), ", ")
    compared = F.col("own") | F.when(F.col("_r"), F.coalesce("_ref", F.lit("none")) != "none").otherwise(F.coalesce("_sc", F.lit(False)))
    return rows.select(key, verdict.alias("verdict"), (F.col("own") | F.coalesce("_r", "_s", F.lit(False))).alias("analysed"), compared.alias("compared"), problems.alias("problems"))


def marks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, mark of files (key, verdict, compared, decision): the decision where there is one; else the verdict, but a clean
    file that wasn't compared is never ticked."""
    uncompared = F.when(F.col("verdict").isin("reject", "review"), F.col("verdict")).when(F.col("verdict") == "ok", "uncompared").otherwise("unknown")
    return rows.select(key, F.when(F.coalesce("decision", F.lit("")) != "", F.col("decision")).when(~F.col("compared"), uncompared).otherwise(F.col("verdict")).alias("mark"))


def reading_queue(rows: DataFrame, n: int | None = None, key: str = "doc_id") -> DataFrame:
    """Files (key, verdict, analysed, compared, decision) in the order they are read in, the first n of them: undecided before
    decided, analysed before others, the worst first; clean but uncompared counts as unknown."""
    verdict = F.when(~F.col("compared") & (F.col("verdict") == "ok"), "unknown").otherwise(F.col("verdict"))
    rank = F.when(verdict == "reject", 0).when(verdict == "review", 1).when(verdict == "unknown", 2).when(verdict == "ok", 3).otherwise(2)
    ordered = rows.orderBy(F.coalesce("decision", F.lit("")) != "", ~F.col("analysed"), rank, key)
    return ordered if n is None else ordered.limit(n)


def index_lines(records: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The little of a check that a list of files needs: key, verdict, kinds, severities (the worst of each kind), compared,
    from records (key, verdict, reference) and their findings (key, kind, severity)."""
    by = found.groupBy(key, "kind").agg(F.max_by("severity", worst(F.col("severity"))).alias("severity")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "severity"))).alias("k"))
    rows = records.join(by, key, "left").withColumn("k", F.coalesce("k", F.array().cast("array<struct<kind:string,severity:string>>")))
    names = F.array_join(F.transform("k", lambda x: x["kind"]), ", ")
    return rows.select(key, F.coalesce("verdict", F.lit("unknown")).alias("verdict"), names.alias("kinds"), F.map_from_entries("k").alias("severities"), (F.coalesce("reference", F.lit("none")) != "none").alias("compared"))


def reviewed(records: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """records (key, verdict) with review: the decision (key, decision, reviewer, note, at) beside what the tool had said; null where nobody decided."""
    made = decisions.select(key, F.col("decision").alias("_d"), "reviewer", "note", "at")
    review = F.when(F.col("_d").isNotNull(), F.struct(F.col("_d").alias("verdict"), "reviewer", F.coalesce("note", F.lit("")).alias("note"), "at", F.col("verdict").alias("tool_said")))
    return records.join(made, key, "left").select(*records.columns, review.alias("review"))


def outcome(rows: DataFrame) -> DataFrame:
    """converted, failed, needs_review of a batch (error, verdict): one row."""
    done = F.col("error").isNull()
    return rows.agg(F.count_if(done).alias("converted"), F.count_if(~done).alias("failed"), F.count_if(done & F.coalesce(F.col("verdict").isin("review", "reject"), F.lit(False))).alias("needs_review"))

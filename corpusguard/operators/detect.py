"""Detectors of damage in a text alone; each gives the kind, the severity and where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import text_metrics

#: Limits that a metric trips on.
LIMITS = {"top_ngram_coverage": 0.45, "tail_ngram_coverage": 0.55, "script_mix_ratio": 0.02, "mojibake_rate": 0.001, "junk_char_rate": 0.005, "short_token_run": 0.10}
MARKERS = "✔✓✗✘xX×—–-•■□▪○●+*·.oO0YyNn│┃|‖§️"
TABLE_ROW = r"( \| |^-+\+-|^\s*\|)"


def switches(word: Column) -> Column:
    """Changes between capital and small letters."""
    flat = F.regexp_replace(F.regexp_replace(word, "[A-Z]", "A"), "[a-z]", "a")
    return F.regexp_count(flat, F.lit("(?=Aa|aA)"))


def scrambled_words(prose: Column) -> Column:
    """The words of six letters or more that change between capital and small letters five times, and on half their letters."""
    hit = lambda w: w.rlike("^[A-Za-z]{6,}$") & w.rlike("[a-z]") & w.rlike("[A-Z]") & (switches(w) >= 5) & (switches(w) >= 0.5 * F.length(w))
    return F.filter(T.tokens(prose, r"[\p{L}\p{N}_]+"), hit)


def scramble_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_scrambled, sample: words of mixed case that change it on half their letters; none under 50 words."""
    prose = F.array_join(F.filter(T.lines(F.coalesce(F.col(text), F.lit(""))), lambda x: ~x.rlike(TABLE_ROW)), "\n")
    rows = docs.select(key, prose.alias("_p"))
    words = F.size(F.filter(F.split("_p", r"(?U)\s+"), lambda w: w.rlike(r"\p{L}")))
    rows = rows.select(key, words.alias("n_words"), scrambled_words(F.col("_p")).alias("_h"))
    enough = F.col("n_words") >= 50
    return rows.select(key, "n_words", F.when(enough, F.size("_h")).otherwise(0).alias("n_scrambled"), F.when(enough, F.array_join(F.slice("_h", 1, 6), ", ")).otherwise("").alias("sample"))


def degenerate_tables(docs: DataFrame, least_cells: int = 12, least_share: float = 0.6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, value, share of the documents whose table cells are nearly all one short value; the value seen first wins ties."""
    rows = docs.select(key, F.filter(T.lines(F.col(text)), lambda x: x.rlike(T.TABULAR)).alias("_r")).filter(F.size("_r") >= 3)
    cells = F.filter(F.flatten(F.transform("_r", lambda r: F.transform(F.split(F.trim(r), r"\s*\|\s*|\t+|\s{2,}"), lambda x: F.trim(x)))), lambda c: c != "")
    rows = rows.select(key, cells.alias("_c")).filter(F.size("_c") >= least_cells)
    each = rows.select(key, F.size("_c").alias("n"), F.posexplode("_c").alias("at", "value"))
    short = each.filter((F.length("value") <= 3) & (F.translate("value", MARKERS, "") != ""))
    counted = short.groupBy(key, "value").agg(F.count("*").alias("c"), F.min("at").alias("first"), F.first("n").alias("n"))
    best = counted.groupBy(key).agg(F.max_by(F.struct("value", "c", "n"), F.struct("c", -F.col("first"))).alias("b"))
    return best.select(key, "b.value", (F.col("b.c").cast("double") / F.col("b.n")).alias("share")).filter(F.col("share") >= least_share)


def control_characters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_junk, junk_char_rate, first_at (0-based) of the texts over the limit; an empty one has no rate."""
    body = F.col(text)
    n = F.regexp_count(body, F.lit(T.JUNK))
    rows = docs.select(key, n.alias("n_junk"), (n.cast("double") / F.nullif(F.length(body), F.lit(0))).alias("junk_char_rate"), (F.regexp_instr(body, F.lit(T.JUNK)) - 1).alias("first_at"))
    return rows.filter(F.col("junk_char_rate") > LIMITS["junk_char_rate"])


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, times, second_at of the commonest prose line (over 3 letters, 3 copies at least); the first of equals."""
    rows = docs.select(key, text, F.posexplode(F.transform(T.prose(F.col(text)), lambda x: F.trim(x))).alias("at", "line")).filter(F.length("line") > 3)
    counted = rows.groupBy(key, "line").agg(F.count("*").alias("times"), F.min("at").alias("first"))
    best = counted.filter("times >= 3").groupBy(key).agg(F.max_by(F.struct("line", "times"), F.struct("times", -F.col("first"))).alias("b")).select(key, "b.line", "b.times")
    found = docs.select(key, text).join(best, key)
    second = f"locate(line, {text}, instr({text}, line) + length(line)) - 1"
    return found.select(key, "line", "times", F.expr(second).alias("second_at"))


def quick_findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, severity from the text alone, without language detection."""
    m = text_metrics(docs, key, text, with_language=False)
    scan = scramble_scan(docs, key, text)
    tables = degenerate_tables(docs, key=key, text=text).select(key, F.lit(True).alias("table"))
    rows = m.join(scan, key, "left").join(tables, key, "left")
    tests = [
        ("repetition_loop", "high", (F.col("top_ngram_coverage") > LIMITS["top_ngram_coverage"]) | (F.col("tail_ngram_coverage") > LIMITS["tail_ngram_coverage"])),
        ("mixed_scripts", "high", F.col("script_mix_ratio") > LIMITS["script_mix_ratio"]),
        ("garbled_characters", "high", F.col("mojibake_rate") > LIMITS["mojibake_rate"]),
        ("control_characters", "medium", F.col("junk_char_rate") > LIMITS["junk_char_rate"]),
        ("letter_spacing", "medium", F.col("short_token_run") > LIMITS["short_token_run"]),
        ("degenerate_table", "medium", F.col("table")),
    ]
    found = [F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))) for kind, severity, test in tests]
    found.append(F.when(F.col("n_scrambled") >= 1, F.struct(F.lit("scrambled_text").alias("kind"), F.when(F.col("n_scrambled") >= 2, "high").otherwise("medium").alias("severity"))))
    return rows.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select(key, "f.kind", "f.severity")

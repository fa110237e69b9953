"""The check of a document from end to end: what a text was compared with, the findings of all checks, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import contain, detect, fidelity, lexicon, places, spans
from .gate import CONFIDENT, SAME_TEXT
from .metrics import NGRAM
from .scoring import kept, worst

#: Share of a text's letters that a source must have, confidence under which a reading is no evidence, shingle and run against a scan.
USABLE, READABLE, SCAN_SHINGLE, SCAN_RUN = 0.2, 0.6, 8, 40


def routes(docs: DataFrame, conf_min: float = READABLE, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, route, notice of documents (key, text, source, recognised, conf): what each can be held against.

    text_layer: the source's own text; recognised: a reading of it that is sure enough; none: no source (no_source), a
    source with too little text (scan_unchecked), or a reading that isn't evidence (scan_unreadable).
    """
    return placed(docs, conf_min, key, text, source).select(key, "route", "notice")


def placed(docs: DataFrame, conf_min: float = READABLE, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with route and notice, which their row tells: no text is moved for them."""
    has = F.col(source).isNotNull()
    usable = T.alnum_count(F.coalesce(F.col(source), F.lit(""))) >= USABLE * F.greatest(T.alnum_count(F.coalesce(F.col(text), F.lit(""))), F.lit(1))
    poor = F.col("recognised") & F.col("conf").isNotNull() & ((F.col("conf") < conf_min) | ~usable)
    notice = F.when(~has, "no_source").when(poor, "scan_unreadable").when(~usable, "scan_unchecked")
    route = F.when(F.col("notice").isNotNull(), "none").when(F.col("recognised"), "recognised").otherwise("text_layer")
    return docs.withColumn("notice", notice).withColumn("route", route)


def route_findings(docs: DataFrame, routed: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, kind, severity: findings about the comparison itself: it could not be made, or its reading is doubtful. Without routed (key,
    route, notice) docs are placed ones."""
    rows = docs if routed is None else docs.select(key, "recognised", "conf").join(routed, key)
    tests = [
        ("scan_unchecked", "medium", F.col("notice") == "scan_unreadable"), ("scan_unchecked", "low", F.col("notice") == "scan_unchecked"),
        ("ocr_confidence", "medium", (F.col("route") == "recognised") & (F.col("conf") < CONFIDENT)),
    ]
    made = F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))) for kind, severity, test in tests])
    return rows.select(key, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("f")).select(key, "f.kind", "f.severity")


def unlooped(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key of the documents whose repetition the source has too: its letters hold the commonest run of NGRAM words half as often as the text, or more."""
    words = T.tokens(T.casefold(F.coalesce(F.col(text), F.lit(""))))
    # a generated column can't be merged into what uses it, where it would be computed anew for each element
    rows = docs.filter(F.col(source).isNotNull()).select(key, T.fold(F.col(source)).alias("_s"), F.explode(F.array(words)).alias("_w"))
    grams = rows.select(key, "_s", "_w", F.explode(F.array(places.commonest(places.gram_hashes(F.col("_w"))))).alias("_g")).filter("_g.n > 0")
    letters = T.fold(F.array_join(F.slice("_w", F.col("_g.first") + 1, F.lit(NGRAM)), " "))
    held = grams.select(key, "_s", F.col("_g.n").alias("n"), letters.alias("_l")).filter("_l <> ''")
    times = (F.length("_s") - F.length(F.replace(F.col("_s"), F.col("_l"), F.lit("")))) / F.length("_l")
    return held.filter(2 * times >= F.col("n")).select(key)


def unscrambled(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, n: how many of a text's scrambled words the source's letters don't have; a word that they have is a name."""
    prose = F.array_join(F.filter(T.lines(F.coalesce(F.col(text), F.lit(""))), lambda x: ~x.rlike(detect.TABLE_ROW)), "\n")
    rows = docs.select(key, prose.alias("_p"), T.fold(F.coalesce(F.col(source), F.lit(""))).alias("_s"))
    return rows.select(key, F.size(F.filter(detect.scrambled_words(F.col("_p")), lambda w: ~F.contains(F.col("_s"), T.fold(w)))).alias("n"))


def settled(found: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Findings of the text alone (key, kind, severity) after a look into the source: loops and scrambled words that it has too are dropped."""
    loops = unlooped(docs, key, text, source).withColumn("_same", F.lit(True))
    words = unscrambled(docs.filter(F.col(source).isNotNull()), key, text, source).withColumnRenamed("n", "_left")
    rows = found.join(loops, key, "left").join(words, key, "left")
    rows = rows.filter(~((F.col("kind") == "repetition_loop") & F.coalesce("_same", F.lit(False))) & ~((F.col("kind") == "scrambled_text") & (F.coalesce("_left", F.lit(1)) == 0)))
    severity = F.when((F.col("kind") == "scrambled_text") & F.col("_left").isNotNull(), F.when(F.col("_left") >= 2, "high").otherwise("medium")).otherwise(F.col("severity"))
    return rows.select(key, "kind", severity.alias("severity"))


def _as(rows: DataFrame, kind: str, severity: str, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "n")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lettered(c: str, least: int) -> Column:
    """Whether a text has so many letters and digits when folded. Folding drops none, so where their first ones are enough the rest isn't folded."""
    body = F.coalesce(F.col(c), F.lit(""))
    return body.rlike(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{least}}}") | (F.length(T.fold(body)) >= least)


def exact_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, kind, severity, n against a source's own text: invented passages, table rows and numbers, repeated passages, misspelt words, and what is missing. A source without letters to compare gives none."""
    docs = docs.filter(_lettered(source, contain.SHINGLE))
    runs = kept(contain.unmatched(docs, text, source, key=key))  # a few short rows a document, asked for twice
    return _all(
        [
            _as(contain.invented_passages(docs, runs, text, key), "invented_text", "high", key),
            _as(contain.merged(contain.unfound_rows(docs, text, source, key), "line", key=key), "unfound_table", "medium", key),
            _as(contain.absent_in(docs, text, source, runs, key=key), "invented_numbers", "high", key),
            _as(contain.merged(contain.repeated_passages(docs, text, source, key=key), "cell", key=key), "duplicated_words", "medium", key),
            _as(contain.spelling_variants(docs, text, source, key=key), "spelling_variants", "low", key),
            _as(contain.missing_text(docs, text, source, key), "missing_from_text", "medium", key),
        ]
    )


def recognised_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, kind, severity, n against a reading of a scan: shorter shingles, longer runs. Where most of the text isn't in the reading, they are two documents, and that is all that is said."""
    docs = docs.filter(_lettered(source, SCAN_SHINGLE) & _lettered(text, 1))
    runs = kept(contain.unmatched(docs, text, source, SCAN_SHINGLE, SCAN_RUN, key))  # asked for three times
    total = docs.select(key, F.aggregate(contain.cells(F.coalesce(F.col(text), F.lit(""))), F.lit(0), lambda a, x: a + F.length(T.fold(x))).alias("_all"))
    gone = runs.groupBy(key).agg(F.sum("n").alias("_gone"))
    share = 1.0 - F.coalesce("_gone", F.lit(0)).cast("double") / F.col("_all")
    other = kept(total.join(gone, key, "left").filter(share < SAME_TEXT).select(key))  # asked for five times
    same = docs.join(other, key, "left_anti")
    runs = runs.join(other, key, "left_anti")
    return _all(
        [
            other.select(key, F.lit("scan_mismatch").alias("kind"), F.lit("high").alias("severity"), F.lit(1).cast("long").alias("n")),
            _as(contain.invented_passages(same, runs, text, key), "not_in_scan", "high", key),
            _as(contain.unmatched(same, source, text, SCAN_SHINGLE, 60, key), "missing_from_text", "medium", key),
            _as(contain.absent_in(same, text, source, runs, misread=True, key=key), "invented_numbers", "medium", key),
        ]
    )


def word_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, kind, severity, n by words and numbers: invented, dropped, retention out of its band, scrambled. For texts whose source has a text layer."""
    balance = fidelity.reconciled(fidelity.balances(docs, text, source, key=key), key)
    total = lambda side: F.aggregate("balance", F.lit(0).cast("long"), lambda a, x: a + x[side])
    # both kinds come from one pass over the balance
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), total(side).alias("n")) for kind, severity, side in (("invented_words", "high", "extra"), ("dropped_words", "medium", "lost"))])
    words = balance.select(key, F.explode(kinds).alias("k")).select(key, "k.*").filter("n > 0")
    kept = fidelity.retention(docs, text, source, key=key).filter("finding <> 'ok'")
    scan = detect.scramble_scan(docs, key, text).filter("n_scrambled > 0")
    return _all(
        [
            words,
            _as(fidelity.invented_numerals(docs, text, source, key), "invented_numbers", "high", key),
            kept.select(key, F.lit("retention").alias("kind"), F.lit("medium").alias("severity"), F.lit(1).cast("long").alias("n")),
            scan.select(key, F.lit("scrambled_text").alias("kind"), F.when(F.col("n_scrambled") >= 2, "high").otherwise("medium").alias("severity"), F.col("n_scrambled").cast("long").alias("n")),
        ]
    )


def check(docs: DataFrame, vocabulary: DataFrame | None = None, conf_min: float = READABLE, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, kind, severity, n: all findings of documents (key, text, source, recognised, conf; source null if there is none).

    The text alone is judged first; what its source explains is dropped. Then each text is held against what its route
    allows; where that isn't a text layer, its words are held against the vocabulary (word), if one is given.
    """
    rows = placed(docs, conf_min, key, text, source)
    alone = settled(detect.quick_findings(docs, key, text), docs, key, text, source).withColumn("n", F.lit(1).cast("long"))
    parts = [alone, route_findings(rows, key=key).withColumn("n", F.lit(1).cast("long")), exact_findings(rows.filter("route = 'text_layer'"), key, text, source), recognised_findings(rows.filter("route = 'recognised'"), key, text, source)]
    if vocabulary is not None:
        words = lexicon.findings(lexicon.suspicious(rows.filter("route <> 'text_layer'"), vocabulary, key, text), key=key)
        parts.append(words.select(key, F.lit("unexpected_words").alias("kind"), F.lit("medium").alias("severity"), F.col("n").cast("long").alias("n")))
    return _all(parts)


def ranked(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings (key, kind, severity, page, char_start) with ord, the order they are read in: the worst first, then by page and place; those without a page last."""
    order = Window.partitionBy(key).orderBy(F.desc(worst(F.col("severity"))), F.col("page").asc_nulls_last(), F.coalesce("char_start", F.lit(0)), "kind")
    return found.withColumn("ord", F.row_number().over(order))


def placed_missing(runs: DataFrame, cells: DataFrame, aside: DataFrame, regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, cell, page, x0, top, x1, bottom of missing passages (key, cell): where they stand in the source, without those of
    which more than half was set aside on purpose.

    cells: key, cell, char_start, char_end in the source; aside: the same of footnotes and margins; regions: key,
    char_start, char_end, page and box.
    """
    rows = runs.select(key, "cell").distinct().join(cells, [key, "cell"])
    over = F.greatest(F.least(F.col("char_end"), F.col("_b")) - F.greatest(F.col("char_start"), F.col("_a")), F.lit(0))
    met = rows.join(aside.select(key, F.col("char_start").alias("_a"), F.col("char_end").alias("_b")), key, "left")
    left = met.groupBy(key, "cell", "char_start", "char_end").agg(F.sum(over).alias("_gone")).filter("coalesce(_gone, 0) <= 0.5 * (char_end - char_start)")
    held = spans.region_boxes(left.select(key, F.col("cell").alias("range_id"), F.col("char_start").alias("a"), F.col("char_end").alias("b")), regions, key)
    first = held.groupBy(key, F.col("range_id").alias("cell")).agg(F.min_by(F.struct("page", "x0", "top", "x1", "bottom"), "page").alias("b")).select(key, "cell", "b.*")
    return left.select(key, "cell").join(first, [key, "cell"], "left")


def inside(ranges: DataFrame, others: DataFrame, bin_size: int = 1024, key: str = "doc_id") -> DataFrame:
    """The ranges (key, a, b) that lie within one of the others (key, c, d); they meet by bins of their starts."""
    cut = others.select(key, "c", "d", F.explode(F.sequence(F.floor(F.col("c") / bin_size), F.floor(F.col("d") / bin_size))).alias("_bin"))
    rows = ranges.withColumn("_bin", F.floor(F.col("a") / bin_size))
    held: Column = (F.col("a") >= F.col("c")) & (F.col("b") <= F.col("d"))
    return rows.join(cut, [key, "_bin"]).filter(held).select(*ranges.columns).distinct()

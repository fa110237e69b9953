"""Structural risk of a source file, its language, and what recognition to trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Weights of the risk signals.
RISK = {"frac_pages_no_text": 2.0, "frac_small_text": 1.5, "frac_lines_rotated": 1.5, "frac_pages_landscape": 0.8, "table_density": 1.2, "text_density": 0.8, "frac_pages_low_dpi": 1.5, "has_type3_font": 0.6}
#: Common words by language, without those of several.
LANGUAGE_WORDS = {
    "eng": "the of and to in that is for with as by this are be on it from which or an at have has not was were their been will would there",
    "fra": "le la les des du et que qui dans pour sur une est aux par ne pas plus avec cette son leur sont ete etre ainsi ou tout comme entre lors",
    "spa": "el los las del que para por con una son como este esta sus segun sobre entre desde tambien todos hacia cuando donde mismo",
    "deu": "der die das und den von zu mit fur im ist des auf dem nicht auch eine als werden wird sind bei nach oder aus einer",
    "ita": "il lo la gli delle della che per con una non sono nel alla dei come anche piu essere stato sulla negli quale",
    "por": "os as do da dos nas que para com uma nao por no na se mais como sao pelo pela seus suas entre quando",
    "nld": "de het een van en dat is op met voor zijn niet aan door worden werd deze wordt bij ook naar over",
    "fin": "ja ei tai kun joka jotka sekä seka tämä tama että etta myös myos olla ovat oli niin mutta kuin sopimus valtion",
}


def marker_words() -> list[tuple[str, str]]:
    """(language, word) of the words that one language alone has."""
    every = [(k, w) for k, v in LANGUAGE_WORDS.items() for w in sorted(set(v.split()))]
    count: dict[str, int] = {}
    for _, w in every:
        count[w] = count.get(w, 0) + 1
    return [(k, w) for k, w in every if count[w] == 1]


def page_signals(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a document from pages (key, n_chars, small, width, height, rotated, rulings, col_edges, dpi)."""
    area = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") * F.col("height") / 5184.0)
    n = F.count("*").cast("double")
    return pages.groupBy(key).agg(
        (F.count_if(F.col("n_chars") < 20) / n).alias("frac_pages_no_text"),
        F.coalesce(F.sum("small") / F.nullif(F.sum("n_chars"), F.lit(0)), F.lit(0.0)).alias("frac_small_text"),
        (F.count_if(F.col("rotated")) / n).alias("frac_lines_rotated"),
        (F.count_if(F.col("width") > F.col("height")) / n).alias("frac_pages_landscape"),
        (F.sum("rulings") / n).alias("ruling_lines_per_page"),
        (F.sum("col_edges") / n).alias("col_edges_per_page"),
        F.coalesce(F.sum("n_chars") / F.sum(area), F.lit(0.0)).alias("chars_per_in2"),
        (F.count_if(F.col("dpi") < 200) / n).alias("frac_pages_low_dpi"),
        (F.max(F.col("type3").cast("double")) if "type3" in pages.columns else F.lit(0.0)).alias("has_type3_font"),
    )


def risk(signals: DataFrame, bar: float = 0.2) -> DataFrame:
    """signals with table_density, text_density, susceptibility, geometry_risk (without scanned pages) and recommended_check."""
    density = F.least(F.lit(1.0), F.col("ruling_lines_per_page") / 20.0 * 0.6 + F.col("col_edges_per_page") / 25.0 * 0.4)
    rows = signals.withColumns({"table_density": density, "text_density": F.least(F.lit(1.0), F.col("chars_per_in2") / 400.0)})

    def mean(names: list[str]):
        total = sum(RISK[n] for n in names)
        return sum((F.lit(RISK[n]) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(n))) for n in names), F.lit(0.0)) / total

    rows = rows.withColumns({"susceptibility": mean(list(RISK)), "geometry_risk": mean([n for n in RISK if n != "frac_pages_no_text"])})
    check = F.when(F.col("frac_pages_no_text") <= 0.5, "diff_vs_text_layer").when(F.col("geometry_risk") >= bar, "self_consistency").otherwise("intrinsic_only")
    return rows.withColumn("recommended_check", check)


def languages(docs: DataFrame, candidates: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, code, share: the language with the most marker words, of 25 words at least; null where that is under 2 % or not
    1.6 times the next. The marker words are a fixed table, so it is broadcast; words are counted before the shuffle."""
    marks = [(k, w) for k, w in marker_words() if candidates is None or k in candidates]
    table = docs.sparkSession.createDataFrame(marks, "code string, word string")
    words = docs.select(key, F.explode(T.tokens(F.lower(text), "[a-zAà-öø-ÿ']+")).alias("word"))
    total = words.groupBy(key).agg(F.count("*").alias("n")).filter("n >= 25")
    hits = words.join(F.broadcast(table), "word").groupBy(key, "code").agg(F.count("*").alias("c"))
    ranked = hits.withColumns({"r": F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), "code")), "next": F.lead("c").over(Window.partitionBy(key).orderBy(F.desc("c"), "code"))}).filter("r = 1")
    rows = total.join(ranked, key, "left").withColumns({"share": F.coalesce("c", F.lit(0)).cast("double") / F.col("n"), "second": F.coalesce("next", F.lit(0)).cast("double") / F.col("n")})
    return rows.select(key, F.when((F.col("share") >= 0.02) & (F.col("share") >= 1.6 * F.col("second")), F.col("code")).alias("code"), "share")


def layer_verdicts(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, verdict, at_page of an old text layer from pages (key, page, confident, lacking), judged page by page.

    poor: 4 % of the confident words are missing from it; sound: under 2 %, or 6 pages. A page decides once there are 150
    words or 3 pages; the last page decides with 30. The first page that decides is the answer.
    """
    order = Window.partitionBy(key).orderBy("page")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumns({"c": F.sum("confident").over(upto), "l": F.sum("lacking").over(upto), "n": F.count("*").over(upto), "last": F.lead("page").over(order).isNull()})
    share = F.when(F.col("c") > 0, F.col("l").cast("double") / F.col("c")).otherwise(0.0)
    enough = (F.col("c") >= 150) | (F.col("n") >= 3)
    final = F.col("last") & (enough | (F.col("c") >= 30))
    verdict = F.when(enough & (share >= 0.04), "poor").when(enough & ((share < 0.02) | (F.col("n") >= 6)), "sound").when(final & (share >= 0.04), "poor").when(final, "sound")
    decided = rows.select(key, "page", verdict.alias("v")).filter("v is not null").groupBy(key).agg(F.min_by("v", "page").alias("verdict"), F.min("page").alias("at_page"))
    return rows.select(key).distinct().join(decided, key, "left").select(key, F.coalesce("verdict", F.lit("undecided")).alias("verdict"), "at_page")


def chosen_pass(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, pass, mass: of several recognition passes (key, page, pass, conf) the one with the largest sum of confidence;
    of equals the first. A first pass with a mean of 75 or more isn't contested."""
    sums = words.groupBy(key, "page", "pass").agg(F.sum("conf").alias("mass"), F.avg("conf").alias("mean"))
    page = Window.partitionBy(key, "page")
    sure = F.max(F.when((F.col("pass") == 1) & (F.col("mean") >= 75), 1).otherwise(0)).over(page) == 1
    rows = sums.withColumn("sure", sure).filter((~F.col("sure")) | (F.col("pass") == 1))
    return rows.withColumn("r", F.row_number().over(page.orderBy(F.desc("mass"), "pass"))).filter("r = 1").select(key, "page", "pass", "mass")


def needs_recognition(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """pages (n_letters) with needs_ocr: never (off), always, or where there are under 20 letters (auto)."""
    test = {"off": F.lit(False), "always": F.lit(True), "auto": F.col("n_letters") < 20}[mode]
    return pages.withColumn("needs_ocr", test)

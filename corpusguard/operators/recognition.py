"""What a recogniser's readings are worth: which pages to read, which reading to keep, in which language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unicode import composed_marks
from .profile import languages

#: Share of a page that a picture covers, confidences (0 to 100) from which a word counts, a page is replaced, a word is kept, a pass is repeated.
FULL_PAGE, CONFIDENT, REPLACE_FROM, KEEP_FROM, RETRY_BELOW = 0.85, 90.0, 60.0, 40.0, 75.0
#: Pictures worth reading: points wide and high, share of the page, and how many of a document.
PICTURE, PICTURE_SHARE, PICTURES = (72.0, 36.0), 0.04, 40
#: The language pack that reads a writing system.
SCRIPT_LANGUAGES = {
    "Cyrillic": "rus", "Arabic": "ara", "Greek": "ell", "Han": "chi_sim", "HanS": "chi_sim", "HanT": "chi_tra", "Japanese": "jpn", "Hangul": "kor", "Korean": "kor", "Hebrew": "heb", "Devanagari": "hin", "Thai": "tha", "Armenian": "hye", "Georgian": "kat",
}
WORD = r"[\p{L}\p{Nl}\p{No}]{3,}"


def _area(width: str = "x1 - x0", height: str = "bottom - top") -> Column:
    return F.abs(F.expr(f"({width}) * ({height})"))


def full_page_pictures(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page of pages that one image (key, page, x0, x1, top, bottom, page_width, page_height) covers nearly whole."""
    page = F.when(F.col("page_width") * F.col("page_height") > 0, F.col("page_width") * F.col("page_height")).otherwise(1.0)
    return images.filter(_area() >= FULL_PAGE * page).select(key, "page").distinct()


def pictures_to_read(images: DataFrame, unexplained: DataFrame, key: str = "doc_id") -> DataFrame:
    """The images worth reading of documents with findings (key) that only a picture could explain: not small, the first PICTURES of each."""
    wide, high = PICTURE
    page = F.col("page_width") * F.col("page_height")
    large = (F.col("x1") - F.col("x0") >= wide) & (F.col("bottom") - F.col("top") >= high) & (_area() >= PICTURE_SHARE * page)
    rows = images.filter(large).join(unexplained.select(key).distinct(), key, "left_semi")
    order = Window.partitionBy(key).orderBy("page", "top", "x0")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= PICTURES).drop("_n")


def layer_words(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, word: the distinct words of three letters or more of a text layer (key, page, text), composed and folded."""
    return words.select(key, "page", F.explode(T.tokens(composed_marks(F.col("text")), WORD)).alias("word")).distinct()


def confident_words(reading: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, word of a reading's words (key, page, text, conf) that are sure, and whole words of three letters or more."""
    return reading.filter((F.col("conf") >= CONFIDENT) & F.col("text").rlike(f"^{WORD}$")).select(key, "page", composed_marks(F.col("text")).alias("word"))


def layer_evidence(layer: DataFrame, reading: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, confident, lacking: the sure words of each page's reading, and how many its text layer lacks. The rows that judge a layer."""
    known = layer_words(layer, key).withColumn("_known", F.lit(True))
    rows = confident_words(reading, key).join(known, [key, "page", "word"], "left")
    return rows.groupBy(key, "page").agg(F.count("*").cast("int").alias("confident"), F.count_if(F.col("_known").isNull()).cast("int").alias("lacking"))


def kept_words(reading: DataFrame, dpi: float = 300.0, least: float = KEEP_FROM, key: str = "doc_id") -> DataFrame:
    """key, page, word, text, x0, x1, top, bottom (points), size, conf of a reading's rows (key, page, block, par, line, word, text, left,
    top, width, height in pixels, conf). A doubtful word stays unless it is a stray mark; the tallest word of a line sets
    the size of all, as a word's own box depends on its letters."""
    scale = 72.0 / dpi
    rows = reading.withColumn("text", F.trim("text")).filter("text <> ''")
    tallest = F.max("height").over(Window.partitionBy(key, "page", "block", "par", "line"))
    rows = rows.withColumn("_line", tallest)
    sure = F.coalesce(F.col("conf"), F.lit(-1.0)) >= least
    x0, top = F.col("left") * scale, F.col("top") * scale
    return rows.filter(sure | (T.alnum_count(F.col("text")) >= 2)).select(key, "page", "word", "text", x0.alias("x0"), (x0 + F.col("width") * scale).alias("x1"), top.alias("top"), (top + F.col("height") * scale).alias("bottom"), (F.col("_line") * scale * 1.05).alias("size"), "conf")


def replaced_pages(pages: DataFrame, readings: DataFrame, verdicts: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, page, source, conf: the reading (key, page, n_words, conf) that each page (key, page, scanned) is taken from.

    A scanned page takes any reading with words; a page whose old text layer is judged poor (verdicts: key, verdict) one
    that is confident enough; all others keep what they have.
    """
    rows = pages.join(readings.select(key, "page", "n_words", F.col("conf").alias("_conf")), [key, "page"], "left")
    rows = rows.join(verdicts.select(key, "verdict"), key, "left") if verdicts is not None else rows.withColumn("verdict", F.lit(None).cast("string"))
    some = F.coalesce("n_words", F.lit(0)) > 0
    relaid = some & ~F.col("scanned") & (F.col("verdict") == "poor") & (F.col("_conf") >= REPLACE_FROM)
    taken = (some & F.col("scanned")) | F.coalesce(relaid, F.lit(False))
    return rows.select(key, "page", F.when(taken, "recognised").otherwise("extracted").alias("source"), F.when(taken, F.col("_conf")).alias("conf"), F.coalesce(relaid, F.lit(False)).alias("relaid"))


def trial_languages(readings: DataFrame, candidates: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, language of a trial reading with all candidates at once: the one its words tell, else all of them together; a trial
    that failed (null text) is read in the first."""
    named = languages(readings.filter(F.col(text).isNotNull()), candidates, key, text)
    rows = readings.join(named.select(key, F.col("code").alias("_named")), key, "left")
    return rows.select(key, F.when(F.col(text).isNull(), candidates[0]).otherwise(F.coalesce("_named", F.lit("+".join(candidates)))).alias("language"))


def page_languages(pages: DataFrame, installed: list[str], key: str = "doc_id") -> DataFrame:
    """key, page, language to read pages (key, page, script, layer_language, trial_language) in: by the writing system if its
    pack is installed (with English for the headers), by the words of the page's own layer, by the document's first trial."""
    packs = F.create_map(*[F.lit(x) for s, code in SCRIPT_LANGUAGES.items() if code in installed for x in (s, code)]) if any(c in installed for c in SCRIPT_LANGUAGES.values()) else F.lit(None).cast("map<string,string>")
    code = F.try_element_at(packs, F.col("script"))
    remembered = F.first("trial_language", ignorenulls=True).over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    with_english = F.concat(code, F.lit("+eng")) if "eng" in installed else code
    layer = F.when(F.col("layer_language").isin(installed), F.col("layer_language"))
    return pages.select(key, "page", F.coalesce(with_english, layer, remembered).alias("language"))

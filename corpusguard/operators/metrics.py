"""Damage metrics of single documents, computed within the row: no shuffle, whatever the corpus."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..functions.unicode import normalised

#: Fixed values of the metrics.
MIN_CHARS, NGRAM, TAIL = 200, 8, 0.2
VOWELLED = ["en", "es", "fr", "it", "pt", "de", "nl"]
STOPWORDS = ["the", "of", "and", "to", "in", "that", "shall", "for", "on", "by"]
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Devanagari", "Armenian", "Georgian"]
#: Letters of a script but Latin; none is below U+0370, which one test tells (Java asks the parts of a class one after the other).
OTHER = r"[\x{370}-\x{10FFFF}&&[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS[1:]) + "]]"
METRICS = ["script_mix_ratio", "vowelless_ratio", "top_ngram_coverage", "tail_ngram_coverage", "dup_line_run", "junk_char_rate", "mojibake_rate", "mean_token_len", "short_token_run"]


def most_repeated(values: Column) -> Column:
    """How often the commonest of an array's hashes occurs: they are sorted in the row and their runs counted."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.array_sort(values), start, step, lambda a: a["best"])


def gram_hashes(words: Column, size: int = NGRAM) -> Column:
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))).otherwise(F.array().cast("array<long>"))


def coverage_of(hashes: Column, n_words: Column) -> Column:
    """Share of n_words words that the commonest n-gram covers; where none repeats, which a hash set tells, nothing is sorted."""
    top = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), most_repeated(hashes)).otherwise(0)
    return F.least(F.lit(1.0), top * F.lit(float(NGRAM)) / n_words)


def mixes_scripts(word: Column) -> Column:
    """Whether a word has letters of several scripts; one of ASCII alone is told by a single test."""
    scripts = sum((F.when(word.rlike(rf"\p{{Is{s}}}"), 1).otherwise(0) for s in SCRIPTS), F.lit(0))
    return F.when(word.rlike(r"[^\x00-\x7F]"), scripts > 1).otherwise(False)


def longest_run(values: Column) -> Column:
    """Length of the longest run of equal values."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(values, start, step, lambda a: a["best"])


def longest_true(flags: Column) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x, a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(flags, start, step, lambda a: a["best"])


def share(array: Column, test) -> Column:
    return F.when(F.size(array) == 0, 0.0).otherwise(F.size(F.filter(array, test)).cast("double") / F.size(array))


@F.pandas_udf(DoubleType())
def gzip_ratio(text: pd.Series) -> pd.Series:
    """Compressed size at level 6 over UTF-8 size; null for an empty text."""

    def one(t: str | None) -> float | None:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if not raw:
            return None
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        return (len(pack.compress(raw)) + len(pack.flush())) / len(raw)

    return text.map(one)


def language(text: Column) -> Column:
    """English by its share of stop words, else unknown."""
    words = T.tokens(F.lower(F.substring(text, 1, 4000)), T.LETTERS)
    return F.when(share(words, lambda w: w.isin(STOPWORDS)) > 0.08, "en").otherwise("unknown")


def text_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text", with_language: bool = True, language_column: str | None = None, pages_column: str | None = None, compressed: bool = False) -> DataFrame:
    """key, counts, language and METRICS of each document; the metrics of a text under MIN_CHARS are null.

    Texts are in NFC first. language_column: the language where the caller knows it (by default English is told from
    the rest); pages_column: adds chars_per_page, null without pages; compressed: adds gzip_ratio, which takes the texts
    through Python.
    """
    body = F.col("_text")
    extra = [F.col(c) for c in dict.fromkeys([language_column, pages_column]) if c]
    rows = normalised(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), *extra), "_text")
    more = [F.when(F.length(body) >= MIN_CHARS, F.length(body).cast("double") / F.nullif(F.col(pages_column), F.lit(0))).alias("chars_per_page")] if pages_column else []
    if compressed:
        rows = rows.withColumn("_gzip", gzip_ratio(body))
        more.append(F.when(F.length(body) >= MIN_CHARS, F.col("_gzip")).alias("gzip_ratio"))
    rows = rows.withColumns({"_prose": F.array_join(T.prose(body), "\n"), "_letters": T.tokens(body, T.LETTERS)})
    rows = rows.withColumns({"_words": T.tokens(F.lower("_prose")), "_plain": T.tokens(F.col("_prose"), T.LETTERS), "_lines": F.filter(F.transform(F.split("_prose", "\n"), lambda x: F.trim(x)), lambda x: x != "")})
    n_chars = F.length(body)
    words, plain, letters, lines = (F.col(c) for c in ("_words", "_plain", "_letters", "_lines"))
    # what more than one expression needs is a column first; grams are hashed once, the tail's are the last of them
    from_tail = F.floor(F.size(words) * (1 - TAIL)).cast("int")
    rows = rows.withColumns({"_grams": gram_hashes(words), "_from": from_tail})
    rows = rows.withColumn("_tail", F.slice("_grams", F.col("_from") + 1, F.greatest(F.size("_grams") - F.col("_from"), F.lit(0))))
    tongue = F.col(language_column) if language_column else language(body) if with_language else F.lit("unknown")
    # a plain vowel, which most words have, spares the translation
    no_vowel = lambda w: ~w.rlike("[aeiouyAEIOUY]") & ~F.translate(F.lower(w), T.ACCENTED, T.PLAIN).rlike("[aeiouy]")
    scorable = n_chars >= MIN_CHARS
    # letters of two scripts in a text are rare: where all are Latin, no word is looked at
    other = body.rlike(OTHER)
    n_tail = F.size(words) - F.col("_from")
    values = {
        "script_mix_ratio": F.when(other, share(letters, mixes_scripts)).otherwise(0.0),
        "top_ngram_coverage": F.when(F.size(words) < 2 * NGRAM, 0.0).otherwise(coverage_of(F.col("_grams"), F.size(words))),
        "tail_ngram_coverage": F.when((F.size(words) < 4 * NGRAM) | (n_tail < 2 * NGRAM), 0.0).otherwise(coverage_of(F.col("_tail"), n_tail)),
        "dup_line_run": F.when(F.size(lines) < 4, 0.0).otherwise((longest_run(lines) - 1).cast("double") / F.size(lines)),
        "junk_char_rate": F.regexp_count(body, F.lit(T.JUNK)).cast("double") / n_chars,
        "mojibake_rate": F.regexp_count(body, F.lit(T.MOJIBAKE)).cast("double") / n_chars,
        "mean_token_len": F.when(F.size(letters) == 0, 0.0).otherwise(F.length(F.array_join(letters, "")).cast("double") / F.size(letters)),
        "short_token_run": F.when(F.size(plain) < 10, 0.0).otherwise(longest_true(F.transform(plain, lambda w: F.length(w) == 1)).cast("double") / F.size(plain)),
        "vowelless_ratio": F.when(F.col("language").isin(VOWELLED), share(F.filter(plain, lambda w: F.length(w) >= 4), no_vowel)),
    }
    rows = rows.withColumn("language", F.when(scorable, tongue).otherwise("unknown"))
    return rows.select(
        key,
        n_chars.alias("n_chars"),
        F.when(n_chars > 0, F.regexp_count(body, F.lit("\n")) + 1).otherwise(0).alias("n_lines"),
        F.when(scorable, F.size(letters)).alias("n_tokens"),
        F.when(scorable, F.size(words)).alias("n_prose_tokens"),
        "language",
        (~scorable).alias("too_short"),
        *[F.when(scorable, values[m]).alias(m) for m in METRICS],
        *more,
    )

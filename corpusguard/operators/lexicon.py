"""A corpus vocabulary and the words that don't belong to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def vocabulary(docs: DataFrame, min_documents: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n_documents: words of two letters at least and the number of documents (rows, each with a key of its own) that have them."""
    words = docs.select(key, F.explode(F.array_distinct(F.filter(T.tokens(T.casefold(F.col(text)), T.LETTERS), lambda w: F.length(w) >= 2))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") >= min_documents)


def suspicious(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word: lower-case words of five letters at least that the vocabulary lacks, unless the word before is capitalised
    and unknown too (a name of two words). The vocabulary grows with the corpus, so it is joined, not broadcast."""
    # a word and the one before it stand in the row, so only candidates travel (the words are a generated column, which
    # can't be merged into the lambda and computed for each word anew)
    rows = docs.select(key, F.explode(F.array(F.filter(T.tokens(F.col(text), T.LETTERS), lambda w: F.length(w) >= 2))).alias("_w"))
    fits = lambda w: (F.length(w) >= 5) & (w == F.lower(w)) & w.rlike(r"\p{Ll}")
    # a pair is one string, the word and the folded one before it where that is capitalised: strings have a hash set in
    # array_distinct, structs are compared with each other, which takes the square of a text's words
    name = lambda i: F.when(i > 0, F.try_element_at("_w", i))
    pairs = F.transform("_w", lambda w, i: F.when(fits(w), F.concat(w, F.lit(" "), F.coalesce(F.when(name(i).rlike(r"^\p{Lu}"), T.casefold(name(i))), F.lit("")))))
    cand = rows.select(key, F.explode(F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))).alias("p"))
    cand = cand.select(key, F.substring_index("p", " ", 1).alias("word"), F.substring_index("p", " ", -1).alias("name"))
    unknown = cand.join(known.select("word"), "word", "left_anti")
    # a word without a name keeps itself, marked, as the key to join by: no key gathers all of them
    asked = unknown.select(key, "word", F.when(F.col("name") == "", F.concat(F.lit(" "), "word")).otherwise(F.col("name")).alias("name"))
    named = asked.join(known.select(F.col("word").alias("name"), F.lit(True).alias("ordinary")), "name", "left")
    return named.filter(F.col("name").startswith(" ") | F.col("ordinary")).select(key, "word").distinct()


def findings(words: DataFrame, least: int = 3, key: str = "doc_id") -> DataFrame:
    """key, n, sample of documents with three suspicious words or more."""
    rows = words.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("word")).alias("w")).filter(F.col("n") >= least)
    return rows.select(key, "n", F.array_join(F.slice("w", 1, 8), ", ").alias("sample"))


def first_place(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word, char_start: the suspicious word (key, word) that stands first in its document's text, and where."""
    rows = words.select(key, "word").join(docs.select(key, F.col(text).alias("_text")), key).select(key, "word", (F.expr("instr(_text, word)") - 1).alias("char_start"))
    return rows.filter("char_start >= 0").groupBy(key).agg(F.min_by("word", F.struct("char_start", "word")).alias("word"), F.min("char_start").alias("char_start"))

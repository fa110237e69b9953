"""Where damage is: the place and a sample of each finding that a text gives by itself, all computed within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .detect import scrambled_words
from .metrics import NGRAM, gram_hashes, mixes_scripts

#: Copies of a line that make a loop, letters that such a line has at least.
COPIES, LINE_LETTERS = 3, 3


def commonest(values: Column) -> Column:
    """(n, first, second) of the commonest of an array's values: how often it occurs and its first two places; of equals the one seen first."""
    placed = F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(None).cast("long").alias("last"), *[none.alias(c) for c in ("first", "second")], F.lit(0).alias("run"), F.struct(F.lit(0).alias("n"), none.alias("first"), none.alias("second")).alias("best"))

    def step(a: Column, v: Column) -> Column:
        same = v["x"].cast("long") == a["last"]
        run = F.when(same, a["run"] + 1).otherwise(1)
        first = F.when(same, a["first"]).otherwise(v["i"])
        second = F.when(same, F.coalesce(a["second"], v["i"])).otherwise(none)
        better = (run > a["best"]["n"]) | ((run == a["best"]["n"]) & (first < a["best"]["first"]))
        best = F.when(better, F.struct(run.alias("n"), first.alias("first"), second.alias("second"))).otherwise(a["best"])
        return F.struct(v["x"].cast("long").alias("last"), first.alias("first"), second.alias("second"), run.alias("run"), best.alias("best"))

    return F.aggregate(placed, start, step, lambda a: a["best"])


def longest_run_place(flags: Column) -> Column:
    """(n, first) of the longest run of true values, the first of equals."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(0).alias("first"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x["f"], a["run"] + 1).otherwise(0)
        better = run > a["n"]
        return F.struct(run.alias("run"), F.when(better, run).otherwise(a["n"]).alias("n"), F.when(better, x["i"] - run + 1).otherwise(a["first"]).alias("first"))

    return F.aggregate(F.transform(flags, lambda f, i: F.struct(f.alias("f"), i.alias("i"))), start, step, lambda a: F.struct(a["n"].alias("n"), a["first"].alias("first")))


def _place(kind: str, start: Column, end: Column, n: Column, sample: Column, test: Column) -> Column:
    return F.when(test, F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), n.cast("int").alias("n"), sample.alias("sample")))


def _element(array: Column, i: Column) -> Column:
    return F.get(array, i)


def damage_places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, char_start, char_end (0-based, half open), n, sample: the first place of each kind of damage that a text has any of.

    repetition_loop: the second copy of the commonest prose line (COPIES at least), else of the commonest run of NGRAM
    words; mixed_scripts: words of several scripts (sample: the first six); garbled_characters and control_characters:
    the first; letter_spacing: the longest run of one-letter words of the prose; scrambled_text: words that change
    between capital and small letters. No limits: whether so much damage is a finding is the detectors' matter.
    """
    body = F.col("_text")
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_letters": T.tokens(body, T.LETTERS), "_prose": F.array_join(T.prose(body), "\n"), "_words": F.transform(T.tokens(body), T.casefold)})
    long = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", "")) > LINE_LETTERS
    rows = rows.withColumns({"_lines": F.filter(F.transform(F.split("_prose", "\n"), lambda x: F.trim(x)), long), "_plain": T.tokens(F.col("_prose"), T.LETTERS)})
    several = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    grams = gram_hashes(F.col("_words"))
    rows = rows.withColumns({"_grams": F.when(F.size("_words") >= 2 * NGRAM, grams), "_hashes": F.transform("_lines", lambda x: F.xxhash64(x))})
    rows = rows.withColumns(
        {
            "_line": F.when(several(F.col("_hashes")), commonest(F.col("_hashes"))), "_gram": F.when(several(F.col("_grams")), commonest(F.col("_grams"))),
            "_mixed": F.filter(F.transform("_letters", lambda w, i: F.when(mixes_scripts(w), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull()),
            "_run": longest_run_place(F.transform("_plain", lambda w: F.length(w) == 1)),
            "_odd": scrambled_words(F.col("_prose")),
        }
    )
    line = _element(F.col("_lines"), F.col("_line.first"))
    once = F.instr(body, line)
    rows = rows.withColumns({"_copy": F.expr("locate(get(_lines, _line.first), _text, instr(_text, get(_lines, _line.first)) + length(get(_lines, _line.first)))"), "_first": F.get("_mixed", F.lit(0))})
    looped = (F.col("_line.n") >= COPIES) & (once > 0) & (F.col("_copy") > 0)
    second = F.col("_gram.second")
    gram_start, gram_last = T.token_start(body, T.WORDS, second), T.token_start(body, T.WORDS, second + NGRAM - 1)
    gram_end = gram_last + F.length(_element(T.tokens(body), second + NGRAM - 1))
    first, last = F.col("_run.first"), F.col("_run.first") + F.col("_run.n") - 1
    from_, upto = T.token_start(F.col("_prose"), T.LETTERS, first), T.token_start(F.col("_prose"), T.LETTERS, last) + 1
    snippet = F.substring(F.col("_prose"), from_ + 1, upto - from_)
    mixed_start = T.token_start(body, T.LETTERS, F.col("_first.i"))
    garbled, junk = F.regexp_instr(body, F.lit(T.MOJIBAKE)), F.regexp_instr(body, F.lit(T.JUNK))
    odd = F.instr(body, F.get("_odd", F.lit(0)))
    empty = F.lit("")
    places = [
        F.coalesce(
            _place("repetition_loop", F.col("_copy") - 1, F.col("_copy") - 1 + F.length(line), F.col("_line.n"), line, looped),
            _place("repetition_loop", gram_start, gram_end, F.col("_gram.n"), F.array_join(F.slice("_words", F.col("_gram.first") + 1, F.lit(NGRAM)), " "), F.col("_gram.n") >= 2),
        ),
        _place("mixed_scripts", mixed_start, mixed_start + F.length("_first.w"), F.size("_mixed"), F.array_join(F.slice(F.array_distinct(F.transform("_mixed", lambda x: x["w"])), 1, 6), ", "), F.size("_mixed") > 0),
        _place("garbled_characters", garbled - 1, garbled - 1 + F.length(F.regexp_extract(body, T.MOJIBAKE, 0)), F.regexp_count(body, F.lit(T.MOJIBAKE)), F.regexp_extract(body, T.MOJIBAKE, 0), garbled > 0),
        _place("control_characters", junk - 1, junk, F.regexp_count(body, F.lit(T.JUNK)), empty, junk > 0),
        _place("letter_spacing", F.instr(body, snippet) - 1, F.instr(body, snippet) - 1 + F.length(snippet), F.col("_run.n"), snippet, (F.col("_run.n") > 1) & (F.instr(body, snippet) > 0)),
        _place("scrambled_text", odd - 1, odd - 1 + F.length(F.get("_odd", F.lit(0))), F.size("_odd"), F.array_join(F.slice("_odd", 1, 6), ", "), F.size("_odd") > 0),
    ]
    return rows.select(key, F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())).alias("p")).select(key, "p.*")


def table_places(docs: DataFrame, tables: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, char_start of the first table row that has a degenerate table's value (key, value) twice or more; null if none has."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(tables.select(key, "value"), key)
    times = lambda row, value: (F.length(row) - F.length(F.replace(row, value, F.lit("")))) / F.length(value)
    held = F.filter(T.lines(F.col("_text")), lambda x: x.rlike(T.TABULAR) & (times(x, F.col("value")) >= 2))
    return rows.select(key, "value", (F.instr(F.col("_text"), F.try_element_at(held, F.lit(1))) - 1).alias("char_start"))


def token_places(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word, char_start, char_end: the first place of each distinct word (key, word) in its document's text."""
    rows = words.select(key, "word").distinct().join(docs.select(key, F.col(text).alias("_text")), key)
    at = F.expr("instr(_text, word)")
    return rows.filter(at > 0).select(key, "word", (at - 1).alias("char_start"), (at - 1 + F.length("word")).alias("char_end"))


def vowelless_words(docs: DataFrame, least: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, words: the distinct words of five letters or more without a vowel, in the order of the text, joined by spaces."""
    test = lambda w: (F.length(w) >= least) & w.rlike("^[A-Za-z]+$") & ~F.lower(w).rlike("[aeiouy]")
    found = F.array_distinct(F.filter(T.tokens(F.coalesce(F.col(text), F.lit("")), T.LETTERS), test))
    return docs.select(key, F.array_join(found, " ").alias("words")).filter("words <> ''")

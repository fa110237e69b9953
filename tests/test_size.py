"""What the steps of large queries cost: how often rows are dealt out, and what runs once a page."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusguard.functions import text as T
from corpusguard.functions import unicode
from corpusguard.operators import contain, layout, lexicon, metrics
from corpusguard.plans.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df) -> int:
    """The different exchanges by key of a plan, whose rows are written."""
    return len({line.split("hashpartitioning")[1].split(", ")[-1] for line in plan(df).splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line})


@pytest.fixture(autouse=True)
def joins_that_shuffle(spark):
    """As with large tables, and with the plan as it is run."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_candidates_are_told_apart_as_strings(spark):
    docs = spark.createDataFrame([(1, "Bonnie zebra zebra Bonnie zebra The zebra quagga"), (2, "quagga the other")], "doc_id long, text string")
    known = spark.createDataFrame([("the",), ("other",)], "word string")
    rows = lexicon.suspicious(docs, known)
    assert sorted(map(tuple, rows.collect())) == [(1, "quagga"), (1, "zebra"), (2, "quagga")]
    # a zebra after Bonnie alone is a name; the square of a text's words is what array_distinct takes on structs
    named = spark.createDataFrame([(1, "Bonnie zebra")], "doc_id long, text string")
    assert lexicon.suspicious(named, known).collect() == []
    assert "array_distinct(" in plan(rows) and "struct(word" not in plan(rows)


def rows_in_order(words):
    """Plain greedy rows of one page."""
    extent, out = [], {}
    for w in sorted(words, key=lambda w: (round(w[3] * 10), w[2], w[1])):
        top, bottom = w[3], w[4]
        for k in range(len(extent) - 1, max(-1, len(extent) - 5), -1):
            a, b = extent[k]
            if min(b, bottom) - max(a, top) > 0.45 * min(bottom - top, b - a):
                extent[k] = [min(a, top), max(b, bottom)]
                out[w[1]] = k
                break
        else:
            extent.append([top, bottom])
            out[w[1]] = len(extent) - 1
    return out


def test_rows_are_grouped_without_a_call_for_each_page(spark):
    rnd = random.Random(3)
    words = []
    for page in (1, 2, 3):
        for n in range(300):
            top = rnd.choice([10.0 * rnd.randrange(12), rnd.randrange(1200) / 10])
            words.append((page, n, float(rnd.randrange(500)), top, top + rnd.choice([0.0, 4.0, 9.0, 25.0])))
    df = spark.createDataFrame([(7, *w, w[2] + 5.0) for w in words], "doc_id long, page long, word long, x0 double, top double, bottom double, x1 double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # pages go on from batch to batch
    try:
        rows = layout.group_rows(df)
        got = {(r.page, r.word): r.row for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(p, w): k for p in (1, 2, 3) for w, k in rows_in_order([x for x in words if x[0] == p]).items()}
    assert "FlatMapGroupsInPandas" not in plan(rows) and "MapInArrow" in plan(rows)


def test_words_are_dealt_out_once_for_lines_and_once_for_gutters(spark, sf):
    assert dealt(QUERIES["text_lines"](spark, sf)) == 2


def test_lines_and_characters_are_dealt_out_once(spark):
    lines = spark.createDataFrame([(1, 1, 1, 0.0, 50.0, 0.0, 10.0), (1, 1, 2, 0.0, 50.0, 8.0, 18.0), (1, 2, 3, 0.0, 50.0, 0.0, 10.0)], "doc_id long, page long, line long, x0 double, x1 double, top double, bottom double")
    marks = [(1, 1, 1, 0.0, 4.0, 8.0, 10.0, 7.0, True), (1, 1, 2, 5.0, 9.0, 8.0, 10.0, 9.0, True), (1, 1, 3, 5.0, 9.0, 14.0, 16.0, 8.0, None), (1, 1, 4, 90.0, 94.0, 4.0, 6.0, 5.0, True), (1, 2, 5, 5.0, 9.0, 4.0, 6.0, None, False), (2, 1, 6, 5.0, 9.0, 4.0, 6.0, 3.0, False)]
    chars = spark.createDataFrame(marks, "doc_id long, page long, char long, x0 double, x1 double, top double, bottom double, size double, bold boolean")
    wanted = [(1, 1, 1, 8.0, True), (1, 1, 2, 8.0, None), (1, 2, 3, None, False)]
    assert dealt(layout.line_fonts(lines, chars)) == 1
    for n in ("1", "2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            assert sorted(map(tuple, layout.line_fonts(lines, chars).collect())) == wanted
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tables_are_cut_in_the_row(spark, sf):
    assert dealt(QUERIES["filled_tables"](spark, sf)) == 0


def test_blocks_are_dealt_out_once(spark, sf):
    assert dealt(QUERIES["page_joins"](spark, sf)) == 1


def test_plain_characters_are_told_by_one_test(spark):
    """The classes hold what the lists of scripts and marks hold, and the first test of each is a range."""
    for pattern, first in ((metrics.OTHER, r"[\x{370}-"), (unicode.COMPOSABLE, r"[\x{300}-")):
        assert pattern.startswith(first + r"\x{10FFFF}&&[")
        inner = pattern.split("&&", 1)[1][:-1]
        every = spark.range(0x110000).filter("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
        assert every.filter(F.col("c").rlike(pattern) != F.col("c").rlike(inner)).count() == 0
        assert every.filter(F.col("c").rlike(pattern)).count() > 500


def test_folding_is_the_same_with_and_without_tables(spark):
    every = spark.range(0x110000).filter("id not between 55296 and 57343").select(F.expr("concat('a B.9 ', decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), 'É')").alias("c")).unionByName(spark.createDataFrame([("Plain, Text 1!",), ("",), ("É-e ß",), (None,)], "c string"))
    plain = F.regexp_replace(F.translate(T.casefold(F.col("c")), T.ACCENTED, T.PLAIN), r"[^\p{L}\p{N}]", "")
    both = every.unionByName(every.withColumn("c", F.regexp_replace("c", "É", "")))
    assert both.filter(~T.fold(F.col("c")).eqNullSafe(plain)).count() == 0


def test_shingles_are_found_without_sorting_and_letters_folded_once(spark):
    rnd = np.random.default_rng(5)
    known = rnd.integers(1, 40, 300).astype(np.uint64) << np.uint64(60)  # many that want one slot
    known = np.concatenate([known, rnd.integers(1, 1 << 60, 5000).astype(np.uint64), np.zeros(9, np.uint64)])
    asked = np.concatenate([rnd.choice(known, 4000), rnd.integers(0, 1 << 60, 4000).astype(np.uint64), np.zeros(5, np.uint64)])
    hit, met = contain._places(known, asked)
    assert sorted(hit.tolist()) == np.flatnonzero((asked > 0) & np.isin(asked, known)).tolist()
    assert (known[met] == asked[hit]).all()
    texts = [("abcdefghijklmno x", "xx abcdefghijkl"), ("", "abc"), ("abcdefghij", "abcdefghij"), ("zzzzzzzzzzzz", "zzzzzzzzzz"), ("abcdefghik", "")]
    for size in (1, 2, 3, 7, 10):
        docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, source string")
        rows = contain.coverage(docs, "text", "source", size)
        wanted = {}
        for i, (text, source) in enumerate(texts):
            held = {source.replace(" ", "")[k : k + size] for k in range(len(source.replace(" ", "")) - size + 1)}
            t = text.replace(" ", "")
            covered = {k + j for k in range(len(t) - size + 1) if t[k : k + size] in held for j in range(size)}
            if t:
                wanted[i] = (len(t), len(covered))
        assert {r.doc_id: (r.n_letters, r.n_covered) for r in rows.collect()} == wanted
    # once for the text and once for its source
    assert plan(rows).count("translate(") == 2

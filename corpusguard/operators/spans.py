"""Spans, anchors and intervals: where in the source a piece of text comes from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import gram_hashes

#: Characters of an interval's bin: intervals and points meet by bin, then exactly.
BIN = 1024


def point_in_span(points: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """points (key, point_id, pos) with the page of the span (key, page, char_start, char_end) that holds pos, else of the
    latest span before it (largest start, then page).

    A span is listed in every bin it touches, so the join is one of equality; the as-of part is a window over the union
    of points and starts, sorted once.
    """
    binned = spans.select(key, "page", "char_start", "char_end", F.explode(F.sequence(F.floor(F.col("char_start") / BIN), F.floor((F.greatest(F.col("char_end") - 1, F.col("char_start"))) / BIN))).alias("bin"))
    asked = points.select(key, "point_id", "pos", F.floor(F.col("pos") / BIN).alias("bin"))
    inside = asked.join(binned, [key, "bin"]).filter("pos >= char_start and pos < char_end").groupBy(key, "point_id").agg(F.min_by("page", F.struct("char_start", "page")).alias("held"))
    timeline = spans.select(key, F.col("char_start").alias("pos"), F.lit(0).alias("kind"), "page", F.lit(None).cast("long").alias("point_id")).unionByName(
        points.select(key, "pos", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("page"), "point_id")
    )
    before = Window.partitionBy(key).orderBy("pos", "kind", "page").rowsBetween(Window.unboundedPreceding, 0)
    earlier = timeline.withColumn("earlier", F.last("page", ignorenulls=True).over(before)).filter("kind = 1").select(key, "point_id", "pos", "earlier")
    return earlier.join(inside, [key, "point_id"], "left").select(key, "point_id", "pos", F.coalesce("held", "earlier").alias("page"))


def region_boxes(ranges: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each range (key, range_id, a, b) and page the box around all spans that overlap it. Bins again; a pair that shares several counts once."""
    cut = lambda df, a, b: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / BIN))))
    left, right = cut(ranges, "a", "b"), cut(spans, "char_start", "char_end")
    met = left.join(right, [key, "bin"]).filter("char_start < b and char_end > a")
    return met.groupBy(key, "range_id", "page").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def anchors(docs: DataFrame, text: str, source: str, sizes: tuple[int, ...] = (5, 3), enough: float = 0.3, key: str = "doc_id") -> DataFrame:
    """key, at, source_at: words of the text anchored to the source by word n-grams that the source has once; the n-gram
    that starts earliest in the text decides.

    Long n-grams are tried first; while fewer than `enough` of the words are anchored, shorter ones are, and the try
    that anchors most words stands. Both sides are in one row: their n-grams meet there as hashes.
    """
    words = lambda c: T.tokens(T.casefold(F.coalesce(F.col(c), F.lit(""))))
    rows = docs.select(key, words(text).alias("_t"), words(source).alias("_s"))

    @F.arrow_udf("array<struct<at:int,source_at:int>>")
    def anchored(n_words: pa.Array, *hashes: pa.Array) -> pa.Array:
        out = []
        for row, n in enumerate(n_words.to_pylist()):
            best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for k, size in enumerate(sizes):
                mine, theirs = (hashes[2 * k + side][row].values.to_numpy() for side in (0, 1))
                values, first, count = np.unique(theirs, return_index=True, return_counts=True)
                values, first = values[count == 1], first[count == 1]
                if not len(values):
                    continue
                place = np.minimum(np.searchsorted(values, mine), len(values) - 1)
                hit = np.flatnonzero(values[place] == mine)
                to = np.full(len(mine) + size, -1, np.int64)
                for d in range(size):  # the earliest n-gram over a word is the one that reaches it last
                    to[hit + d] = first[place[hit]] + d
                found = np.flatnonzero(to >= 0)
                if len(found) > len(best[0]):
                    best = found, to[found]
                if len(best[0]) >= enough * n:
                    break
            out.append([{"at": a, "source_at": b} for a, b in zip(best[0].tolist(), best[1].tolist(), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("source_at", pa.int32())])))

    grams = [gram_hashes(F.col(c), size) for size in sizes for c in ("_t", "_s")]
    return rows.select(key, F.explode(anchored(F.size("_t"), *grams)).alias("a")).select(key, "a.at", "a.source_at")


def token_spans(docs: DataFrame, text: str, pattern: str = T.WORDS, key: str = "doc_id") -> DataFrame:
    """key, at, token, char_start, char_end: the tokens of a pattern and where they stand, 0-based and half open."""
    rows = docs.select(key, F.posexplode(T.with_spans(F.coalesce(F.col(text), F.lit("")), pattern)).alias("at", "t"))
    end = F.sum(F.col("t.gap") + F.length("t.token")).over(Window.partitionBy(key).orderBy("at"))
    return rows.withColumn("char_end", end).select(key, "at", F.col("t.token").alias("token"), (F.col("char_end") - F.length("t.token")).alias("char_start"), "char_end")


def region_index(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, char_start, char_end, page and the box around all spans that share them; spans without characters are left out."""
    held = spans.filter("char_end > char_start")
    return held.groupBy(key, "char_start", "char_end", "page").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def line_offsets(lines: DataFrame, blocks: DataFrame, prefix: int = 24, key: str = "doc_id") -> DataFrame:
    """key, block, line, char_start, char_end of the lines (key, block, line, text) that blocks (key, block, text, char_start,
    char_end) were joined from: each begins where its first `prefix` characters stand in the block, and ends where the
    next begins; a line not found there has the whole block's range."""
    held = blocks.select(key, "block", F.col("text").alias("_block"), F.col("char_start").alias("_start"), F.col("char_end").alias("_end"))
    rows = lines.join(held, [key, "block"])
    at = F.expr(f"instr(_block, substring(text, 1, {prefix}))")
    rows = rows.withColumn("_at", F.when((F.length("text") > 0) & (at > 0), F.col("_start") + at - 1))
    following = F.min("_at").over(Window.partitionBy(key, "block").orderBy("line").rowsBetween(1, Window.unboundedFollowing))
    return rows.select(key, "block", "line", F.coalesce("_at", "_start").alias("char_start"), F.when(F.col("_at").isNull(), F.col("_end")).otherwise(F.coalesce(following, F.col("_end"))).alias("char_end"))


def line_pages(votes: DataFrame, lines: DataFrame, default_page: int = 1, key: str = "doc_id") -> DataFrame:
    """key, line, page of lines (key, line) by the majority of votes (key, line, page; equals: the smallest page); a line
    without votes takes the page of the line before."""
    counted = votes.groupBy(key, "line", "page").agg(F.count("*").alias("n")).groupBy(key, "line").agg(F.max_by("page", F.struct("n", -F.col("page"))).alias("voted"))
    upto = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(key, "line").join(counted, [key, "line"], "left")
    return rows.select(key, "line", F.coalesce(F.last("voted", ignorenulls=True).over(upto), F.lit(default_page)).alias("page"))


def page_ranges(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ranges: page numbers as text, runs written a-b."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("page"))
    runs = pages.select(key, "page").distinct().withColumn("g", F.col("page") - n).groupBy(key, "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))).alias("r")).select(key, F.array_join(F.transform("r", lambda x: x["s"]), ", ").alias("ranges"))


def offsets(blocks: DataFrame, gap: int = 2, key: str = "doc_id") -> DataFrame:
    """blocks (key, block, text) with char_start and char_end in the assembled text."""
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0))
    return blocks.select(key, "block", start.alias("char_start"), (start + F.length("text")).alias("char_end"))

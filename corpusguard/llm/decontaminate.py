"""Benchmark decontamination: passages of every document query a BM25 index of the test items by block-max WAND."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textkit import pieces, prefix_sums, shingles, span_hashes

#: Words of a passage, words from one to the next, words of an indexed unit at most (each lies whole in some passage).
PASSAGE, STRIDE, UNIT = 48, 16, 32
#: Share of a unit's own BM25 score that a passage must reach; share of the item's word 5-grams the document must hold.
THRESHOLD, OVERLAP, NGRAM, ANSWER_WORDS = 0.5, 0.8, 5, 5
#: Share of the threshold that the commonest terms may score together.
COMMON = 0.9
#: Units in a block with its own maxima; bytes of items in one index (larger sets go through in blocks).
BLOCK, INDEX_BYTES = 8, 32 << 20
K1, B = 1.2, 0.75

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word (letters and digits) of the lower-cased texts."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = _LETTER[data]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    own = np.searchsorted(np.cumsum(lengths + 1) - lengths - 1, starts, "right") - 1
    return span_hashes(prefix_sums(data), starts, ends), own


@dataclass
class Index:
    """Inverted index of units. Impacts are shares of the unit's own score, so that one threshold fits all."""

    terms: np.ndarray  # sorted hashes
    first: np.ndarray  # postings of term t: first[t]:first[t+1], by unit
    units: np.ndarray
    impacts: np.ndarray
    most: np.ndarray  # by term
    block_first: np.ndarray  # blocks of term t: block_first[t]:block_first[t+1], in order
    blocks: np.ndarray
    block_postings: np.ndarray  # where the postings of each of these begin
    block_most: np.ndarray  # largest impact there
    common: np.ndarray  # the terms of most units; in no unit do they score COMMON of the threshold together
    common_score: np.ndarray  # what they score together, by unit
    common_most: np.ndarray  # the most of that, by block
    unit_item: np.ndarray
    item_ids: list
    question: list[np.ndarray]
    answer: list[np.ndarray]

    def __post_init__(self) -> None:
        """What single cursors read, as plain sequences: bisecting these takes a fraction of a call into numpy."""
        self.at_unit, self.at_block = (array("q", x.astype(np.int64).tobytes()) for x in (self.units, self.blocks))
        self.from_posting, self.from_block = self.first.tolist(), self.block_first.tolist()
        self.top, self.block_top, self.worth = (array("d", x.astype(np.float64).tobytes()) for x in (self.most, self.block_most, self.impacts))

    def most_in(self, term: int, block: int) -> float:
        end = self.from_block[term + 1]
        at = bisect_left(self.at_block, block, self.from_block[term], end)
        return self.block_top[at] if at < end and self.at_block[at] == block else 0.0


def build_index(items: list[tuple[int, str | None, str | None]]) -> Index | None:
    """An index of items (id, text, answer: of its own, or null for the end of the text); None if no item has a word."""
    ids, texts = [i for i, _, _ in items], [f"{t or ''} {a or ''}" for _, t, a in items]
    words, own = _words(texts)
    if not len(words):
        return None
    count = np.bincount(own, minlength=len(ids))
    at = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    # an item of n words has ceil(n / UNIT) units of nearly equal length
    parts = np.maximum(1, -(-count // UNIT))
    unit_of = (np.cumsum(parts) - parts)[own] + at * parts[own] // np.maximum(1, count[own])
    n = int(parts.sum())
    terms, term = np.unique(words, return_inverse=True)
    pair, tf = np.unique(term.astype(np.int64) * n + unit_of, return_counts=True)
    t, u = pair // n, pair % n
    df = np.bincount(t, minlength=len(terms))
    length = np.bincount(unit_of, minlength=n)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[u] / max(1.0, length[length > 0].mean())))
    impact = weight / np.bincount(u, weight, n)[u]
    most = np.zeros(len(terms))
    np.maximum.at(most, t, impact)
    common, common_score = np.zeros(len(terms), bool), np.zeros(n)
    first = np.searchsorted(t, np.arange(len(terms) + 1))
    for k in np.argsort(-df, kind="stable").tolist():
        postings = slice(first[k], first[k + 1])
        if df[k] < 2 or (common_score[u[postings]] + impact[postings]).max() > COMMON * THRESHOLD:
            break
        common_score[u[postings]] += impact[postings]
        common[k] = True
    n_blocks = -(-n // BLOCK)
    head = np.flatnonzero(np.append(True, np.diff(t * n_blocks + u // BLOCK) > 0))
    block_first = np.searchsorted(t[head], np.arange(len(terms) + 1))
    common_most = np.maximum.reduceat(common_score, np.arange(0, n, BLOCK))
    question, answer = [], []
    for k in range(len(ids)):
        w = words[own == k]
        s, _ = shingles(w, np.zeros(len(w), np.int64), NGRAM, 1)
        own_words = len(_words([items[k][2]])[0]) if items[k][2] else 0
        tail = min(len(s), max(1, own_words - NGRAM + 1) if own_words else ANSWER_WORDS)
        question.append(s[: len(s) - tail])
        answer.append(s[len(s) - tail :])
    return Index(terms, first, u, impact, most, block_first, u[head] // BLOCK, np.append(head, len(u)), np.maximum.reduceat(impact, head), common, common_score, common_most, np.repeat(np.arange(len(ids)), parts), ids, question, answer)


def wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All units that score at least the threshold for the distinct terms of a query.

    The terms' cursors stand in order of their next unit. The pivot is the first term at which the sum of maxima reaches
    the threshold; nothing before its unit can. If the block maxima there fall short too, the cursors skip the block.
    """
    first, units, impacts, most = index.from_posting, index.at_unit, index.worth, index.top
    cursors = [[units[first[t]], first[t], first[t + 1], t] for t in query]
    found = []

    def skip(c: list[int], unit: int) -> None:
        c[1] = bisect_left(units, unit, c[1], c[2])
        c[0] = units[c[1]] if c[1] < c[2] else 1 << 60

    while True:
        cursors = sorted(c for c in cursors if c[0] < 1 << 60)
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += most[c[3]]
            if total >= threshold - 1e-9:
                pivot = k
                break
        if pivot < 0:
            return found
        unit = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
            pivot += 1
        block = unit // BLOCK
        if sum(index.most_in(c[3], block) for c in cursors[: pivot + 1]) < threshold - 1e-9:
            # no unit before the block's end, or before the next cursor's unit, can reach it
            upto = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60)
            for c in cursors[: pivot + 1]:
                skip(c, max(upto, unit + 1) if upto > unit else unit + 1)
        elif cursors[0][0] == unit:
            score = sum(impacts[c[1]] for c in cursors[: pivot + 1])
            if score >= threshold - 1e-9:
                found.append((unit, float(score)))
            for c in cursors[: pivot + 1]:
                skip(c, unit + 1)
        else:
            for c in cursors[:pivot]:
                if c[0] < unit:
                    skip(c, unit)


def _matches(index: Index, texts: list[str], threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, best score, question overlap, answer overlap)."""
    words, own = _words(texts)
    if not len(words):
        return
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    term = np.where(index.terms[at] == words, at, -1)
    known = term >= 0
    count = np.bincount(own, minlength=len(texts))
    first = np.cumsum(count) - count
    n_passages = np.maximum(1, -(-(count - PASSAGE) // STRIDE) + 1) * (count > 0)
    before = np.cumsum(n_passages) - n_passages
    doc = np.repeat(np.arange(len(texts)), n_passages)
    start = first[doc] + STRIDE * (np.arange(len(doc)) - before[doc])
    end = np.minimum(start + PASSAGE, (first + count)[doc])
    # all passages' cursors move at once over the blocks of their rarer terms: a block is in reach of a passage if its
    # maxima for these, and the most that all common terms score in a unit there, add up to the threshold
    rare = np.flatnonzero(known & ~index.common[term])
    place = rare - first[own[rare]]
    met = []
    for back in range(PASSAGE // STRIDE):
        number = place // STRIDE - back
        good = (number >= 0) & (number < n_passages[own[rare]])
        met.append((before[own[rare]] + number)[good] * len(index.terms) + term[rare][good])
    pair = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
    passage, t = pair // len(index.terms), pair % len(index.terms)
    many = index.block_first[t + 1] - index.block_first[t]
    ends = np.cumsum(many)
    at = np.repeat(index.block_first[t] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
    n_blocks, n_units = len(index.common_most), len(index.common_score)
    asked = np.repeat(passage, many)
    near, own_near = np.unique(asked * n_blocks + index.blocks[at], return_inverse=True)
    reach = np.bincount(own_near, index.block_most[at], len(near)) + index.common_most[near % n_blocks] >= threshold - 1e-6
    # only postings of blocks in reach are read: the same sum by unit tells the passages that WAND is asked for
    kept = reach[own_near]
    at, asked = at[kept], asked[kept]
    many = index.block_postings[at + 1] - index.block_postings[at]
    ends = np.cumsum(many)
    posting = np.repeat(index.block_postings[at] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
    cell, own_cell = np.unique(np.repeat(asked, many) * n_units + index.units[posting], return_inverse=True)
    met = np.bincount(own_cell, index.impacts[posting], len(cell)) + index.common_score[cell % n_units] >= threshold - 1e-6
    hits: dict[tuple[int, int], float] = {}
    for p in np.unique(cell[met] // n_units).tolist():
        query = np.unique(term[start[p] : end[p]])
        for unit, score in wand(index, query[query >= 0].tolist(), threshold):
            pair = int(doc[p]), int(index.unit_item[unit])
            hits[pair] = max(score, hits.get(pair, 0.0))
    seen: dict[int, np.ndarray] = {}
    for (d, k), score in sorted(hits.items()):
        if d not in seen:
            w = words[first[d] : first[d] + count[d]]
            seen = {d: np.unique(shingles(w, np.zeros(len(w), np.int64), NGRAM, 1)[0])}
        q, a = index.question[k], index.answer[k]
        in_q, in_a = (np.isin(x, seen[d]) for x in (q, a))
        if in_q.sum() + in_a.sum() >= overlap * (len(q) + len(a)) and in_a.any():
            # a short item is nothing but its answer
            yield d, k, score, float((in_q if len(q) else in_a).mean()), float(in_a.mean())


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", item_answer: str | None = None) -> DataFrame:
    """Pairs (key, item_id) of documents and the test items they hold, with score, question_overlap and answer_overlap.

    Words are runs of letters and digits, lower-cased, so case and punctuation don't hide a passage. Every document is
    cut into overlapping passages; each queries the index and all units above the threshold are retrieved; an item
    counts if the whole document holds `overlap` of its word 5-grams, some of them of its answer (the column item_answer, which follows the text, or without one the text's last words). Items
    of fewer than five words have one gram, all their words. A null or empty text, or an item without words, matches
    nothing; equal rows are answered alike, a row each; other columns don't matter.

    The items pass in blocks of INDEX_BYTES at most, each broadcast and matched against all documents.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    items_type = items.schema[item_key].dataType
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    picked = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t"), (F.col(item_answer) if item_answer else F.lit(None)).cast("string").alias("a")).filter("t is not null").dropDuplicates()
    size = picked.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("a"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // INDEX_BYTES))
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    out = None
    for b in range(blocks):
        own = picked if blocks == 1 else picked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(build_index(sorted((tuple(r) for r in own.collect()), key=str)))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for first, last, buffer, starts in pieces(batch.column(1)) if index else ():
                    ends = np.append(starts[1:] - 1, len(buffer))
                    texts = [str(buffer[a:z], "utf-8", "replace") for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                    found = list(_matches(index, texts, threshold, overlap))
                    if found:
                        d, k, *values = zip(*found, strict=True)
                        ids = batch.column(0).slice(first, last - first).take(pa.array(d))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([index.item_ids[x] for x in k], to_arrow_type(items_type)), *(pa.array(v, pa.float64()) for v in values)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = rows.mapInArrow(match, schema)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("doc_id", key)


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no test item, all columns. All rows of a key go if one holds an item; those with a null key count as one key's."""
    key = options.get("key", "doc_id")
    gone = find_leaks(docs, items, **options).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")

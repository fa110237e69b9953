"""Letter-level containment: which stretches of a text occur in its source, in any order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import gram_hashes

#: Letters of a shingle, of a run that counts, of a line judged as a whole; findings of one kind.
SHINGLE, MIN_RUN, LINE_MIN, LINE_SHARE, MAX_PASSAGES = 10, 25, 30, 0.5, 60
#: Letters that are hashed at a time.
PIECE = 1 << 19
_FACTOR, _DOCUMENT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def cells(c: Column) -> Column:
    """The chunks between tabs, bars and line ends, cut again at wide gaps, in order."""
    chunks = F.filter(F.split(c, r"[\t|\n]"), lambda x: x != "")
    return F.filter(F.flatten(F.transform(chunks, lambda x: F.split(x, " {2,}"))), lambda x: x.rlike(r"\S"))


def folded_cells(docs: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """key, cell, chunk, letters."""
    rows = docs.select(key, F.posexplode(cells(F.coalesce(F.col(text), F.lit("")))).alias("cell", "chunk"))
    return rows.withColumn("letters", T.fold(F.col("chunk")))


def _rolled(letters: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size letters, from those of runs of half the length."""
    if size == 1:
        mixed = (letters + np.uint64(1)) * _FACTOR
    else:
        half = size // 2
        part = _rolled(letters, half)
        n = len(letters) - size + 1
        mixed = part[:n] * _FACTOR
        mixed ^= mixed >> np.uint64(31)
        mixed += part[half : half + n]
        if size % 2:
            mixed *= _FACTOR
            mixed ^= mixed >> np.uint64(31)
            mixed += letters[size - 1 :]
        mixed *= _DOCUMENT
    mixed ^= mixed >> np.uint64(29)
    return mixed


def _places(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked hashes (0: none) are known, and where one of the equal ones stands there.

    A table with a slot for an eighth of a hash; where two different ones want a slot the last has it, and those that lost
    theirs have another table, until none is left. Sorting them would cost a comparison for each halving.
    """
    left, open_ = np.flatnonzero(known), np.flatnonzero(asked)
    hits, met = [], []
    factor = _FACTOR
    while len(left) and len(open_):
        bits = max(10, int(8 * len(left)).bit_length())
        shift = np.uint64(64 - bits)
        slots = ((known[left] * factor) >> shift).astype(np.int64)
        table = np.full(1 << bits, -1, np.int32)
        table[slots] = left
        had = table[((asked[open_] * factor) >> shift).astype(np.int64)]
        same = (had >= 0) & (known[had] == asked[open_])
        hits.append(open_[same])
        met.append(had[same].astype(np.int64))
        # an empty slot tells that a hash isn't known
        open_ = open_[~same & (had >= 0)]
        left = left[known[table[slots]] != known[left]]
        factor = np.uint64((int(factor) * int(_DOCUMENT) + 2) % (1 << 64))  # odd again
    if not hits:
        return open_[:0], open_[:0]
    return np.concatenate(hits), np.concatenate(met)


def _pairs(letters: np.ndarray) -> np.ndarray:
    """Each letter and the next as one number."""
    pairs = letters.copy()
    pairs[:-1] |= letters[1:] << np.uint64(32)
    return pairs


def _windows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of a column of string arrays as code points, cell after cell; start of each cell; document of each cell; and
    for each letter a hash of it and the size-1 after it, 0 where that leaves the cell."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().fill_null("")
    lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    docs = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    n = len(letters)
    hashes = np.zeros(n, np.uint64)
    if n >= size:
        rolled = _rolled(letters, size)
        hashes[: n - size + 1] = rolled | np.uint64(1)
    # a shingle of another document is another shingle
    hashes *= np.repeat((np.arange(len(column), dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _DOCUMENT | np.uint64(1), np.bincount(docs, lengths, len(column)).astype(np.int64))
    left = np.repeat(starts[1:], lengths) - np.arange(n)
    hashes[left < size] = 0
    return letters, starts, docs, hashes


def uncovered(size: int):
    """Of a text's cells and its source's cells (folded): the runs of letters in no shingle that the source has, as (cell, start, n).

    Text and source stand in one row, and the test needs a set of the source's shingles, which built-in functions don't
    have: exploding both sides would shuffle ten bytes for each letter. So the rows go to numpy in Arrow batches, all
    shingles of a batch are hashed and looked up at once, and nothing is shuffled. Where hashes are equal, so are the
    letters: they are compared.
    """
    kind = pa.list_(pa.struct([("cell", pa.int32()), ("start", pa.int32()), ("n", pa.int32())]))

    @F.arrow_udf("array<struct<cell:int,start:int,n:int>>")
    def gaps(cells_: pa.Array, source: pa.Array) -> pa.Array:
        # some documents at a time, so that what is held doesn't depend on the batch
        long = np.zeros(len(cells_), np.int64)
        for column in (cells_, source):
            lengths = np.concatenate([[0], np.cumsum(pc.utf8_length(column.flatten().fill_null("")).to_numpy(zero_copy_only=False))])
            ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
            long += np.diff(lengths[ends], prepend=0).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(long) // PIECE)) + 1
        parts = [some(cells_.slice(a, b - a), source.slice(a, b - a)) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells_)], strict=True)]
        return pa.concat_arrays(parts)

    def some(cells_: pa.Array, source: pa.Array) -> pa.Array:
        letters, starts, docs, mine = _windows(cells_, size)
        theirs, _, _, known = _windows(source, size)
        hit, met = _places(known, mine)
        # two letters at a time; the last two again where their number is odd
        ours, others = (letters, theirs) if size == 1 else (_pairs(letters), _pairs(theirs))
        same = np.ones(len(hit), bool)
        for k in sorted({*range(0, size - 1, 2), max(size - 2, 0)}):
            same &= ours[hit + k] == others[met + k]
        hit = hit[same]
        change = np.zeros(len(letters) + 1, np.int32)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + size, -1)
        bare = np.cumsum(change[:-1]) == 0
        cell_of = np.repeat(np.arange(len(docs)), np.diff(starts))
        # a gap begins at a bare letter after a covered one, or at a cell's first
        before = np.append(False, bare[:-1] & (cell_of[1:] == cell_of[:-1])) if len(bare) else bare
        begins = np.flatnonzero(bare & ~before)
        run = np.cumsum(bare & ~before) - 1
        n = np.bincount(run[bare], minlength=len(begins)) if len(begins) else np.zeros(0, np.int64)
        own = cell_of[begins]
        first_cell = np.searchsorted(docs, np.arange(len(cells_)))
        found = pa.StructArray.from_arrays([pa.array((own - first_cell[docs[own]]).astype(np.int32)), pa.array((begins - starts[own]).astype(np.int32)), pa.array(n.astype(np.int32))], ["cell", "start", "n"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(docs[own], minlength=len(cells_)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), found).cast(kind)

    return gaps


def gap_rows(docs: DataFrame, text: str, source: str, size: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """key, letters (the text's folded cells), gaps (their uncovered runs)."""
    folded = lambda c: F.transform(cells(F.coalesce(F.col(c), F.lit(""))), T.fold)
    # a generated column can't be merged into a filter or a sum, where it would be computed anew
    rows = docs.select(key, F.explode(F.array(F.struct(folded(text).alias("letters"), folded(source).alias("_source")))).alias("_f")).select(key, "_f.*")
    return rows.select(key, "letters", F.explode(F.array(uncovered(size)(F.col("letters"), F.col("_source")))).alias("gaps"))


def coverage(docs: DataFrame, text: str, source: str, size: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """key, n_letters, n_covered over all cells: letters under at least one known shingle."""
    rows = gap_rows(docs, text, source, size, key)
    total = F.aggregate("letters", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select(key, total.alias("n_letters"), F.aggregate("gaps", F.lit(0).cast("long"), lambda a, g: a + g["n"]).alias("_gone")).filter("n_letters > 0").select(key, "n_letters", (F.col("n_letters") - F.col("_gone")).alias("n_covered"))


def unmatched(docs: DataFrame, text: str, source: str, size: int = SHINGLE, min_run: int = MIN_RUN, key: str = "doc_id") -> DataFrame:
    """key, cell, start, n, stop: runs of letters in no known shingle, of min_run at least; a cell of LINE_MIN letters that is
    mostly uncovered is given once, from its first such letter to its last, with the number of them. Starts and stops count
    the cell's letters."""
    rows = gap_rows(docs, text, source, size, key).filter(F.size("gaps") > 0)
    each = rows.select(key, "gaps", F.posexplode(F.transform("letters", lambda x: F.length(x))).alias("cell", "n_letters")).filter(F.col("n_letters") >= min(min_run, LINE_MIN))
    each = each.withColumn("gaps", F.filter("gaps", lambda g: g["cell"] == F.col("cell"))).filter(F.size("gaps") > 0)
    missing = F.aggregate("gaps", F.lit(0), lambda a, g: a + g["n"])
    whole = (F.col("n_letters") >= LINE_MIN) & (missing > LINE_SHARE * F.col("n_letters"))
    last = F.element_at("gaps", -1)
    first = F.struct(F.col("gaps")[0]["start"].alias("start"), missing.alias("n"), (last["start"] + last["n"]).alias("stop"))
    long = F.transform(F.filter("gaps", lambda g: g["n"] >= min_run), lambda g: F.struct(g["start"].alias("start"), g["n"].alias("n"), (g["start"] + g["n"]).alias("stop")))
    return each.select(key, "cell", F.explode(F.when(whole, F.array(first)).otherwise(long)).alias("g")).select(key, "cell", "g.start", "g.n", "g.stop")


def word_coverage(docs: DataFrame, text: str, source: str, size: int = 3, key: str = "doc_id") -> DataFrame:
    """key, share of the text's words under a word n-gram of the source; 1 where either side is shorter than that.

    Both sides stand in one row, so their n-grams' hashes meet there and nothing is shuffled.
    """
    words = lambda c: T.tokens(T.casefold(F.coalesce(F.col(c), F.lit(""))))
    rows = docs.select(key, words(text).alias("_t"), words(source).alias("_s"))
    hit = covered_words(size)(gram_hashes(F.col("_t"), size), gram_hashes(F.col("_s"), size))
    rows = rows.select(key, F.size("_t").alias("n"), F.size("_s").alias("m"), hit.alias("hit"))
    return rows.select(key, F.when((F.col("n") < size) | (F.col("m") < size), 1.0).otherwise(F.col("hit").cast("double") / F.col("n")).alias("share"))


def covered_words(size: int):
    """Of the n-grams' hashes of a text and of its source: how many of the text's words lie in one that both have."""

    @F.arrow_udf("int")
    def count(mine: pa.Array, theirs: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(mine, theirs, strict=True):
            at = np.flatnonzero(np.isin(a.values.to_numpy(), b.values.to_numpy())) if a.is_valid and b.is_valid else np.zeros(0, np.int64)
            out.append(int(np.minimum(size, np.diff(at, append=1 << 40)).sum()))
        return pa.array(out, pa.int32())

    return count


def uncovered_words(docs: DataFrame, text: str, source: str, size: int = 3, key: str = "doc_id") -> DataFrame:
    """key, start, n: the runs of words of the text under no word n-gram of the source; none where the text, or a source with
    words, is shorter than an n-gram. Starts count words."""
    words = lambda c: T.tokens(T.casefold(F.coalesce(F.col(c), F.lit(""))))
    rows = docs.select(key, words(text).alias("_t"), words(source).alias("_s"))
    n, m = F.size("_t"), F.size("_s")

    @F.arrow_udf("array<struct<start:int,n:int>>")
    def runs(mine: pa.Array, theirs: pa.Array, total: pa.Array) -> pa.Array:
        out = []
        for a, b, count in zip(mine, theirs, total.to_pylist(), strict=True):
            bare = np.ones(count + 2, bool)
            for at in np.flatnonzero(np.isin(a.values.to_numpy(), b.values.to_numpy())).tolist() if a.is_valid and b.is_valid else []:
                bare[1 + at : 1 + at + size] = False
            bare[[0, -1]] = False
            edge = np.diff(bare.astype(np.int8))
            out.append([{"start": s, "n": e - s} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))

    found = runs(gram_hashes(F.col("_t"), size), gram_hashes(F.col("_s"), size), n)
    judged = rows.filter((n >= size) & ((m >= size) | (m == 0))).select(key, F.explode(found).alias("r"))
    return judged.select(key, "r.start", "r.n")


def invented_passages(docs: DataFrame, runs: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """key, passage, times, first_cell: unmatched cells (from unmatched()) made distinct by their letters; the first MAX_PASSAGES of a document."""
    rows = folded_cells(docs, text, key).join(runs.select(key, "cell").distinct(), [key, "cell"], "left_semi")
    grouped = rows.groupBy(key, F.col("letters").alias("passage")).agg(F.count("*").alias("times"), F.min("cell").alias("first_cell"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first_cell"))
    return grouped.withColumn("r", rank).filter(F.col("r") <= MAX_PASSAGES).select(key, "passage", "times", "first_cell")


def repeated_passages(docs: DataFrame, text: str, source: str, least: int = 40, key: str = "doc_id") -> DataFrame:
    """key, cell, times, in_source: the copies of a cell beyond those in the source, which has it at least once."""
    rows = folded_cells(docs, text, key).filter(F.length("letters") >= least)
    nth = F.row_number().over(Window.partitionBy(key, "letters").orderBy("cell"))
    many = rows.withColumns({"nth": nth, "times": F.count("*").over(Window.partitionBy(key, "letters"))}).filter("times > 1")
    sources = docs.select(key, T.fold(F.coalesce(F.col(source), F.lit(""))).alias("_s"))
    counted = many.join(sources, key).withColumn("in_source", ((F.length("_s") - F.length(F.replace(F.col("_s"), F.col("letters"), F.lit("")))) / F.length("letters")).cast("int"))
    return counted.filter("in_source > 0 and nth > in_source").select(key, "cell", "times", "in_source")


def absent_numbers(docs: DataFrame, text: str, source: str, key: str = "doc_id") -> DataFrame:
    """key, value, at: numbers of which some part (cut at - and /) is nowhere in the source's digits."""
    once = docs.select(key, T.digit_runs(F.coalesce(F.col(source), F.lit(""))).alias("_runs"), T.tokens(F.coalesce(F.col(text), F.lit("")), T.NUMBER).alias("_n"))
    rows = once.select(key, "_runs", F.posexplode("_n").alias("at", "value"))
    parts = F.filter(F.transform(F.split("value", "[-/]"), lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: x != "")
    return rows.filter(F.exists(parts, lambda p: ~F.contains(F.col("_runs"), p))).select(key, "value", "at")


def cell_numbers(docs: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """key, cell, value, first, last: each number of the text, the cell it is in, and the places of its letters among the cell's."""
    rows = docs.select(key, F.posexplode(cells(F.coalesce(F.col(text), F.lit("")))).alias("cell", "chunk")).filter(F.col("chunk").rlike(r"\d"))
    each = rows.select(key, "cell", "chunk", F.posexplode(T.tokens(T.ascii_digits(F.col("chunk")), T.NUMBER)).alias("nth", "value"))
    start = T.token_start(F.col("chunk"), T.NUMBER, F.col("nth"))
    first = F.length(T.fold(F.substring(F.col("chunk"), F.lit(1), start)))
    return each.select(key, "cell", "value", first.alias("first"), (first + F.length(T.fold(F.col("value")))).alias("last"))


def absent_in(docs: DataFrame, text: str, source: str, taken: DataFrame, misread: Column | bool = False, key: str = "doc_id") -> DataFrame:
    """key, cell, value: numbers of the text of which some part (cut at - and /) is nowhere in the source's digits, outside the
    runs already taken (key, cell, start, stop). Where misread holds, a part of two digits or more may also be one digit
    away from a number of the source, as a recogniser's errors are."""
    once = docs.select(key, T.digit_runs(T.ascii_digits(F.coalesce(F.col(source), F.lit("")))).alias("_runs"), (misread if isinstance(misread, Column) else F.lit(misread)).alias("_misread"))
    parts = F.filter(F.transform(F.split("value", "[-/]"), lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: x != "")
    digits = lambda a, b: F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    close = lambda p: F.col("_misread") & (F.length(p) >= 2) & F.exists(F.split("_runs", r"\|"), lambda r: (F.length(r) == F.length(p)) & (digits(r, p) <= 1))
    rows = cell_numbers(docs, text, key).join(once, key).filter(F.exists(parts, lambda p: ~F.contains(F.col("_runs"), p) & ~close(p)))
    held = taken.select(F.col(key).alias("_k"), F.col("cell").alias("_c"), F.col("start").alias("_a"), F.col("stop").alias("_b"))
    inside = (F.col(key) == F.col("_k")) & (F.col("cell") == F.col("_c")) & (F.col("first") < F.col("_b")) & (F.col("last") > F.col("_a"))
    return rows.join(held, inside, "left_anti").select(key, "cell", "value")


def merged(rows: DataFrame, at: str, gap: int = 1, key: str = "doc_id") -> DataFrame:
    """key, first, last, n of runs of rows (key, at) whose places are at most `gap` apart: neighbouring lines or cells are one finding."""
    order = Window.partitionBy(key).orderBy(at)
    fresh = F.when(F.col(at) - F.lag(at).over(order) <= gap, 0).otherwise(1)
    groups = rows.select(key, at).withColumn("_g", fresh).withColumn("_g", F.sum("_g").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy(key, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_g")


def unfound_rows(docs: DataFrame, text: str, source: str, key: str = "doc_id") -> DataFrame:
    """key, line, n_cells, n_unfound: table rows of two cells at least, of which two and half aren't in the source.

    A cell under two shingles long is found if the source's letters have it whole; a longer one may be split up there,
    so it is found if half its letters are in shingles that the source has.
    """
    short = 2 * SHINGLE
    letters = lambda c: T.fold(F.coalesce(F.col(c), F.lit("")))
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.when(x.rlike(r"[\t|]"), F.struct(i.alias("line"), F.filter(F.transform(F.split(x, r"[\t|]"), T.fold), lambda c: c != "").alias("c"))))
    rows = docs.select(key, letters(source).alias("_s"), F.transform(cells(F.coalesce(F.col(source), F.lit(""))), T.fold).alias("_k"), F.filter(lines, lambda x: x.isNotNull() & (F.size(x["c"]) >= 2)).alias("_l")).filter(F.size("_l") > 0)
    rows = rows.withColumn("_gaps", uncovered(SHINGLE)(F.flatten(F.transform("_l", lambda x: x["c"])), F.col("_k")))
    each = rows.select(key, "_s", "_gaps", F.flatten(F.transform("_l", lambda x: F.transform(x["c"], lambda c: F.struct(x["line"].alias("line"), c.alias("c"))))).alias("_c"))
    each = each.select(key, "_s", "_gaps", F.posexplode("_c").alias("at", "x")).select(key, "_s", F.col("x.line").alias("line"), F.col("x.c").alias("c"), F.aggregate(F.filter("_gaps", lambda g: g["cell"] == F.col("at")), F.lit(0), lambda a, g: a + g["n"]).alias("_bare"))
    found = F.when(F.length("c") < short, F.contains(F.col("_s"), F.col("c"))).otherwise(2 * F.col("_bare") <= F.length("c"))
    return each.groupBy(key, "line").agg(F.count("*").cast("int").alias("n_cells"), F.count_if(~found).cast("int").alias("n_unfound")).filter("n_unfound >= greatest(2, 0.5 * n_cells)")


#: What stands between the cells of a text.
SEPARATOR = r"[\t|\n]| {2,}"


def cell_spans(docs: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """key, cell, chunk, char_start: the cells of cells(), and where each stands in the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.arrays_zip(F.split(body, SEPARATOR).alias("chunk"), T.tokens(body, SEPARATOR).alias("gap"))
    rows = docs.select(key, F.posexplode(parts).alias("at", "p")).select(key, "at", "p.chunk", (F.length("p.chunk") + F.coalesce(F.length("p.gap"), F.lit(0))).alias("_n"))
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("char_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("chunk").rlike(r"\S"))
    cell = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return rows.select(key, cell.alias("cell"), "chunk", F.col("char_start").cast("int").alias("char_start"))


def run_places(docs: DataFrame, runs: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """key, cell, char_start, char_end, sample of runs (key, cell, start, stop, of folded letters): their characters in the text,
    widened to the words that they cut."""
    from ..functions.unicode import folded_with_places

    held = cell_spans(docs, text, key).join(runs.select(key, "cell", "start", "stop"), [key, "cell"])
    rows = held.withColumn("_p", folded_with_places(F.col("chunk"))["places"])
    rows = rows.withColumns({"_a": F.get("_p", F.col("start")), "_b": F.get("_p", F.col("stop") - 1) + 1})
    left = F.length(F.regexp_extract(F.substring(F.col("chunk"), F.lit(1), F.col("_a")), r"[\p{L}\p{N}]*$", 0))
    right = F.length(F.regexp_extract(F.substring(F.col("chunk"), F.col("_b") + 1, F.length("chunk")), r"^[\p{L}\p{N}]*", 0))
    rows = rows.withColumns({"_a": F.col("_a") - left, "_b": F.col("_b") + right}).filter("_a is not null and _b is not null")
    sample = T.quote(F.substring(F.col("chunk"), F.col("_a") + 1, F.col("_b") - F.col("_a")))
    return rows.select(key, "cell", (F.col("char_start") + F.col("_a")).alias("char_start"), (F.col("char_start") + F.col("_b")).alias("char_end"), sample.alias("sample"))


#: Words up to this length are found by their deletions, which take its square in letters; longer ones are compared.
SHORT_WORD = 64


def _near(a: str, b: str) -> bool:
    """Whether two words, each with at most one letter left out, can be the same."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    p = next((k for k in range(n) if a[k] != b[k]), n)
    return a == b or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :] or (len(a) == len(b) and (_moved(a[p:], b[p:]) or _moved(b[p:], a[p:])))


def _moved(a: str, b: str) -> bool:
    """Whether a without its first letter is b without one of its letters (both of a length)."""
    n = len(a) - 1
    k = next((k for k in range(n) if a[k + 1] != b[k]), n)
    return a[k + 1 :] == b[k + 1 :]


def _variants(mine: list[str], theirs: list[str]) -> list[tuple[str, str]]:
    """(word, near): for each of my words the first of theirs that is near it."""
    open_, found = dict.fromkeys(mine), {}
    short: dict[str, list[str]] = {}
    for word in mine:
        if len(word) <= SHORT_WORD:
            for d in {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}:
                short.setdefault(d, []).append(word)
    long: dict[int, list[str]] = {}
    for word in mine:
        if len(word) > SHORT_WORD:
            long.setdefault(len(word), []).append(word)
    lengths = {len(w) + k for w in mine for k in (-1, 0, 1)}
    for near in theirs:
        if len(near) not in lengths:
            continue
        met = [w for n in (-1, 0, 1) for w in long.get(len(near) + n, ()) if w in open_ and _near(w, near)]
        if len(near) <= SHORT_WORD + 1:
            for d in (near, *(near[:k] + near[k + 1 :] for k in range(len(near)))):
                met += short.get(d, ())
        for word in met:
            if word in open_:
                del open_[word]
                found[word] = near
        if not open_:
            break
    return list(found.items())


def variants_in(least: int):
    """Of the folded words of a text and of its source (joined by spaces), and the source's letters: (word, near) of words that aren't in the letters."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("near", pa.string())]))

    @F.arrow_udf("array<struct<word:string,near:string>>")
    def find(text: pa.Array, source: pa.Array, letters: pa.Array) -> pa.Array:
        out = []
        for k in range(len(text)):
            theirs = dict.fromkeys(w for w in source[k].as_py().split(" ") if len(w) >= least)
            mine = [w for w in dict.fromkeys(text[k].as_py().split(" ")) if len(w) >= least and w not in theirs]
            if mine:
                held = letters[k].as_py()
                mine = [w for w in mine if w not in held]
            out.append([{"word": w, "near": n} for w, n in _variants(mine, list(theirs))] if mine else [])
        return pa.array(out, kind)

    return find


def spelling_variants(docs: DataFrame, text: str, source: str, least: int = 4, key: str = "doc_id") -> DataFrame:
    """key, word, near: words of the text that aren't in the source's letters, but within a deletion on either side of one of its words.

    Text and source stand in one row: the deletions of the text's few such words are kept, and those of the source's words
    are looked up among them, so nothing is shuffled and no word is compared with all. The nearest is the source word seen
    first.
    """
    # folded together, as that costs one pass for all words; a space is a space before and after
    body = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = lambda c: F.regexp_replace(F.translate(T.casefold(F.array_join(T.tokens(body(c), T.LETTERS), " ")), T.ACCENTED, T.PLAIN), r"[^\p{L}\p{N} ]", "")
    differ = docs.filter(body(text) != body(source))
    return differ.select(key, F.explode(variants_in(least)(words(text), words(source), T.fold(body(source)))).alias("v")).select(key, "v.*")


def missing_text(docs: DataFrame, text: str, source: str, key: str = "doc_id") -> DataFrame:
    """key, cell, start, n: unmatched() with the roles turned round and long runs only."""
    return unmatched(docs, source, text, min_run=60, key=key)


def set_aside(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, line, reason of lines (x0, x1, top, bottom, size, page_height) that aren't body text: margin text standing
    upright, and footnotes: small, below the last line of normal size, in the lower half; pages of four lines at least."""
    page = Window.partitionBy(key, "page")
    flat = (F.col("bottom") - F.col("top")) <= 2.5 * (F.col("x1") - F.col("x0"))
    rows = lines.withColumns({"flat": flat}).withColumns({"mid": F.expr("percentile(case when flat then size end, 0.5)").over(page), "n_flat": F.sum(F.col("flat").cast("int")).over(page)})
    normal = F.col("flat") & (F.col("size") >= 0.9 * F.col("mid"))
    rows = rows.withColumn("last_normal", F.max(F.when(normal, F.col("bottom"))).over(page))
    foot = F.col("flat") & (F.col("n_flat") >= 4) & (F.col("size") < 0.9 * F.col("mid")) & (F.col("top") >= F.col("last_normal")) & (F.col("top") > F.col("page_height") / 2)
    return rows.select(key, "page", "line", F.when(~F.col("flat"), "margin").when(foot, "footnote").alias("reason")).filter("reason is not null")

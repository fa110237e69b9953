"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .textkit import hashed_words, mix, pieces, shingles
from .workspace import lookup, partitions, staged

#: At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS = 1e-7.
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Members of a bucket that are compared with one another, or with those of another block, in one group.
BLOCK = 256
_probes: list[np.ndarray] = []


def _probe(attempt: int) -> np.ndarray:
    """The bin that each empty bin borrows from at an attempt: the same for all documents."""
    while len(_probes) <= attempt:
        seeds = np.arange(BINS, dtype=np.uint64) + np.uint64(len(_probes) + 1) * np.uint64(1_000_003)
        _probes.append((mix(mix(seeds)) % np.uint64(BINS)).astype(np.int64))
    return _probes[attempt]


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row), piece by piece."""
    for first, last, buffer, starts in pieces(column):
        hashes, docs = hashed_words(buffer, starts)
        values, own = shingles(hashes, docs, size, last - first)
        cuts = np.searchsorted(own, np.arange(last - first + 1))
        sets = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x = np.sort(values[a:b])
            sets.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
        yield first, sets


def densified(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each set; the row of an empty set is all EMPTY.

    Each element falls into one bin; a bin keeps its smallest value. An empty bin borrows from the bins of its probe
    sequence, the first that was filled by an element.
    """
    out = np.full((len(sets), BINS), EMPTY)
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    if not counts.sum():
        return out
    h = mix(np.concatenate(sets) ^ np.uint64(0xA5A5A5A5DEADBEEF))
    row = np.repeat(np.arange(len(sets)), counts)
    cell = row * BINS + ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    value = h & np.uint64(0xFFFFFFFF)
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    out.ravel()[cell[first]] = np.minimum.reduceat(value, first)
    filled = out != EMPTY
    rows, bins = np.nonzero(~filled & (counts > 0)[:, None])
    attempt = 0
    while len(rows):
        source = _probe(attempt)[bins] if attempt < 2000 else (bins + attempt - 1999) % BINS
        good = filled[rows, source]
        out[rows[good], bins[good]] = out[rows[good], source[good]]
        rows, bins = rows[~good], bins[~good]
        attempt += 1
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS keys of each row, different bands having different keys."""
    x = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), x.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k])
    return key.view(np.int64)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, sets in shingle_sets(batch.column(2), size):
                keys = band_keys(densified(sets))
                counts = np.fromiter(map(len, sets), np.int64, len(sets))
                prints = [mix(s).sum(dtype=np.uint64).tobytes() + mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).tobytes() + len(s).to_bytes(8, "little") if len(s) else None for s in sets]
                offsets = np.arange(0, (len(sets) + 1) * BANDS, BANDS, dtype=np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()), mask=pa.array(counts == 0))
                rows = pa.array(np.arange(number, number + len(sets)))
                number += len(sets)
                yield pa.RecordBatch.from_arrays([rows, *(batch.column(c).slice(first, len(sets)) for c in (0, 1)), pa.array(counts), pa.array(prints, pa.binary()), bands], ["row", "doc_id", "digest", "n_shingles", "print", "bands"])

    return run


def _confirm(size: int, percent: int):
    """Rows (hub, salt, leaf, text) sorted so that a hub's own text (leaf null) precedes its leaves': yields confirmed (hub, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            hubs, leaves, found = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for first, sets in shingle_sets(batch.column(3), size):
                for k, s in enumerate(sets, first):
                    if leaves[k] is None:
                        hub, own = hubs[k], s
                    elif hubs[k] == hub and len(own):
                        at = np.searchsorted(own, s)
                        both = int((own[np.minimum(at, len(own) - 1)] == s).sum())
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            found.append((hub, leaves[k]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["hub", "leaf"])

    return run


def _confirmed(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those edges (hub, leaf) whose texts (node, text) are similar on their full sets. A hub's text is copied once for each 500 leaves."""
    spark = edges.sparkSession
    degrees = edges.groupBy("hub").agg(F.ceil(F.count("*") / 500).cast("int").alias("salts"))
    hubs = degrees.join(texts, F.col("hub") == F.col("node")).select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("leaf"), "text")
    n_edges = edges.count()
    salted = lookup(edges, degrees.withColumn("n", F.col("salts") * 500), "hub", "n", n_edges, nulls=False)
    leaves = salted.join(texts, F.col("leaf") == F.col("node")).select("hub", F.pmod(F.xxhash64("leaf"), F.col("salts")).cast("int").alias("salt"), "leaf", "text")
    dealt = hubs.unionByName(leaves).repartition(partitions(spark), "hub", "salt").sortWithinPartitions("hub", "salt", F.col("leaf").asc_nulls_first())
    return dealt.mapInArrow(_confirm(size, percent), "hub bigint, leaf bigint")


def _links_in(band: int, rows: list[tuple], percent: int) -> set[tuple[int, int]]:
    """Links between components, of rows (component, block, bands, set) in different ones, and in different blocks if there are two.

    A pair is compared in the first of its common buckets alone.
    """
    parts, blocks = (np.array([r[c] for r in rows], np.int64) for c in range(2))
    bands, sets = np.array([r[2] for r in rows], np.int64), [r[3] for r in rows]
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(codes, np.cumsum(counts)[:-1])
    one_block, held, found = (blocks == blocks[0]).all(), np.zeros(len(values), bool), set()
    for i in range(len(rows) - 1):
        fits = (parts[i + 1 :] != parts[i]) & (100 * np.minimum(counts[i + 1 :], counts[i]) >= percent * np.maximum(counts[i + 1 :], counts[i]))
        if not one_block:
            fits &= blocks[i + 1 :] != blocks[i]
        others = np.flatnonzero(fits) + i + 1
        same = bands[others] == bands[i]
        others = others[(bands[i][same.argmax(1)] == band) | ~same.any(1)]
        if not len(others):
            continue
        held[own[i]] = True
        both = np.fromiter((np.count_nonzero(held[own[k]]) for k in others.tolist()), np.int64, len(others))
        held[own[i]] = False
        for k in others[100 * both >= percent * (counts[i] + counts[others] - both)].tolist():
            found.add((int(min(parts[i], parts[k])), int(max(parts[i], parts[k]))))
    return found


def _compare(size: int, percent: int):
    """Rows (band, low, high, block, component, bands, text) sorted by the first three, which make a group: yields its links (a, b) between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[pa.RecordBatch]:
            found = _links_in(at[0], rows, percent) if len(rows) > 1 and (at[1] == at[2] or len({r[1] for r in rows}) > 1) else ()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        at, rows = None, []
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            heads = list(zip(*(batch.column(c).to_pylist() for c in (4, 3, 5)), strict=True))
            for first, sets in shingle_sets(batch.column(6), size):
                for k, s in enumerate(sets, first):
                    if groups[k] != at:
                        yield from links()
                        at, rows = groups[k], []
                    rows.append((*heads[k], s))
        yield from links()

    return run


def _all_links(open_: DataFrame, texts: DataFrame, sketches: DataFrame, n_rows: int, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components, of all members of a bucket that are in different ones; open_ has band, node, component.

    A bucket's largest component and its other members are dealt into blocks. Each block of the others meets all blocks,
    so members of the largest component are copied once for each block of the others.
    """
    per = open_.groupBy("band", "component").agg(F.count("*").alias("n"))
    most = per.groupBy("band").agg(F.max(F.struct("n", "component")).alias("big"), F.sum("n").alias("size"))
    plan = most.select("band", "size", F.col("big.component").alias("largest"), F.ceil((F.col("size") - F.col("big.n")) / BLOCK).cast("int").alias("n_rest"), F.ceil(F.col("big.n") / BLOCK).cast("int").alias("n_big"))
    bands = sketches.select(F.col("row").alias("node"), "bands").join(open_.select("node").distinct(), "node")
    held = staged(texts.join(bands, "node"), "held")
    draw, rest = F.xxhash64("node"), F.col("component") != F.col("largest")
    block = F.when(rest, F.pmod(draw, F.col("n_rest"))).otherwise(F.col("n_rest") + F.pmod(draw, F.col("n_big"))).cast("int")
    last = F.when(rest, F.col("n_rest") + F.col("n_big")).otherwise(F.col("n_rest")) - 1
    dealt = lookup(open_, plan, "band", "size", n_rows * BANDS, nulls=False).select("band", "node", "component", block.alias("block"), last.alias("last")).join(held, "node")
    met = dealt.select("band", "component", "block", "bands", "text", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    met = met.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "component", "bands", "text")
    met = met.repartition(partitions(open_.sparkSession), "band", "low", "high").sortWithinPartitions("band", "low", "high")
    return met.mapInArrow(_compare(size, percent), "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, shingle: int = 2, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, n_shingles, component_id (smallest key reachable over links, its own included), kept (key = component_id).

    A document's set is its distinct word shingles (words: runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased);
    with fewer words its whole sequence; a null or empty text has an empty set and is linked with nothing. Documents
    with |A and B| >= threshold * |A or B| are linked; the threshold counts in whole hundredths. Keys are integers and
    need not be unique: each row is a node of its own, so rows that share a key can be in different components. A row
    whose key is null joins its component, which is named by its smallest key that isn't; a component without one (and
    a linkless row with a null key) has a null component_id, and such rows are kept. No rows give no rows; other
    columns don't matter.

    Rows with equal sets become one node first (sets are told apart by 128 bits of sums of hashes, and their size).
    Nodes that share a band form a bucket, whose members are compared with one hub alone: the smallest node in the
    first round. Components are then contracted: later rounds take only buckets that still span several components,
    and only links between components. In each, another member becomes a bucket's hub and is compared with the members
    of other components, unless that pair was tried. When a round leaves more than 80 % of what was open, all members
    of the open buckets are compared with all members of other components there, so no bucket is left unsearched. Every
    link is confirmed on the full sets. A pair at the threshold shares no bucket with a chance of about 1e-7.
    """
    percent = round(threshold * 100)
    if abs(percent - threshold * 100) > 1e-9:
        raise ValueError("the threshold counts in whole hundredths")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    sketches = staged(rows.mapInArrow(_sketch(shingle), "row bigint, doc_id bigint, digest bigint, n_shingles bigint, print binary, bands array<bigint>"), "sketches")
    n_rows = sketches.count()
    filled = sketches.filter("print is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_key"), "doc_id", "row", "digest")).alias("first")
    classes = filled.groupBy("print").agg(first, F.min("doc_id").alias("low"), F.count("*").alias("size"))
    classes = staged(classes.select("print", F.col("first.row").alias("node"), F.col("first.digest").alias("digest"), "low", "size"), "classes")
    nodes = filled.join(classes.select(F.col("node").alias("row")), "row")
    banded = staged(nodes.select(F.col("row").alias("node"), F.explode("bands").alias("band")), "banded")
    shared = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    members = staged(lookup(banded, staged(shared, "shared"), "band", "size", n_rows * BANDS, nulls=False).filter("hub is not null"), "members")
    wanted = classes.join(members.select("node").distinct(), "node").select("node", "low", "digest")
    same = F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("digest") == F.col("wanted_digest"))
    texts = rows.join(wanted.withColumnRenamed("digest", "wanted_digest"), same).groupBy("node").agg(F.min("text").alias("text"))
    texts = staged(texts, "texts")
    tried = staged(members.filter("node <> hub").select("hub", F.col("node").alias("leaf")).distinct(), "tried")
    links = staged(_confirmed(tried, texts, shingle, percent), "links")
    parts = components(links, "hub", "leaf")
    open_ = _open(members.select("band", "node").join(parts, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), n_rows)
    roots = None
    left = open_.count()
    while left:
        order = F.xxhash64(F.lit(left), "band", "node")
        hubs = open_.groupBy("band").agg(F.min(F.struct(order.alias("o"), "node", "component")).alias("first"), F.count("*").alias("size"))
        hubs = hubs.select("band", F.col("first.node").alias("hub"), F.col("first.component").alias("hub_component"), "size")
        meet = lookup(open_, hubs, "band", "size", n_rows * BANDS, nulls=False).filter("component <> hub_component")
        pair = [F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("leaf")]
        met = staged(meet.select(*pair, F.col("hub_component").alias("a"), F.col("component").alias("b")).distinct(), "met")
        new = staged(met.select("hub", "leaf").distinct().join(tried, ["hub", "leaf"], "left_anti"), "new")
        added = _confirmed(new, texts, shingle, percent)
        roots, open_ = _contracted(met.join(added, ["hub", "leaf"]).select("a", "b"), roots, open_, n_rows)
        before, left = left, open_.count()
        if 5 * left > 4 * before:
            break
        tried = staged(tried.unionByName(new), "tried")
    if left:
        roots, open_ = _contracted(_all_links(open_, texts, sketches, n_rows, shingle, percent), roots, open_, n_rows)
    placed = staged(classes.join(parts, "node", "left").select("print", "low", "size", F.coalesce("component", "node").alias("component")), "placed")
    if roots is not None:
        # many classes can be in one component: its root reaches them as a hot key does
        sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
        moved = staged(sizes.join(roots, sizes.component == roots.node, "left").select("component", "root", "n"), "moved")
        placed = staged(lookup(placed, moved, "component", "n", n_rows, nulls=False).select("print", "low", "size", F.coalesce("root", "component").alias("component")), "placed")
    names = placed.groupBy("component").agg(F.min("low").alias("name"), F.count("*").alias("n"))
    # a component is a row of names; those of many classes reach them by broadcast
    named = lookup(placed, names, "component", "n", n_rows, nulls=False).select("print", "name", "size")
    out = lookup(sketches.select("doc_id", "n_shingles", "print"), staged(named, "named"), "print", "size", n_rows)
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("name"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _open(members: DataFrame, n_rows: int) -> DataFrame:
    """Those of the members (band, node, component) whose bucket spans several components."""
    members = staged(members, "members")
    spans = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    # every bucket has its row, so that a large one that is done with is known as hot too
    spans = staged(spans.select("band", "size", (F.col("low") != F.col("high")).alias("spans")), "spans")
    return staged(lookup(members, spans, "band", "size", n_rows * BANDS, nulls=False).filter("spans").select("band", "node", "component"), "open")


def _contracted(links: DataFrame, roots: DataFrame | None, open_: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Merge components over links (a, b) between them: roots (node: a component of the first round, root: what it is part of now) and the members still open."""
    links = staged(links.filter("a <> b").distinct(), "links")
    if not links.limit(1).count():
        return roots, open_
    merged = components(links, "a", "b").withColumnRenamed("component", "root")
    if roots is None:
        moved = merged
    else:
        far = merged.select(F.col("node").alias("_root"), F.col("root").alias("_far"))
        old = roots.join(far, F.col("root") == F.col("_root"), "left").select("node", F.coalesce("_far", "root").alias("root"))
        moved = staged(old.unionByName(merged.join(roots, "node", "left_anti")), "roots")
    sizes = open_.groupBy("component").count()
    # components that nothing was merged into have their row too: a large one must be known as hot
    found = staged(sizes.join(merged, sizes.component == merged.node, "left").select("component", "root", "count"), "found")
    renamed = lookup(open_, found, "component", "count", open_.count(), nulls=False)
    return moved, _open(renamed.select("band", "node", F.coalesce("root", "component").alias("component")), n_rows)


def drop_near_copies(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay (one document of each component), all columns. A key goes if none of its rows stays; rows with a null key stay."""
    found = near_copies(docs, shingle, threshold, key, text)
    gone = found.groupBy(F.col(key).alias("_gone")).agg(F.max("kept").alias("_kept")).filter("not _kept")
    return docs.join(gone.select("_gone"), F.col(key) == F.col("_gone"), "left_anti")

"""Removal of repeated passages by a sparse suffix array, merged from front-coded sorted runs.

Two documents that share a window of `width` bytes share the place in it whose `GRAM` bytes hash lowest (its anchor). So
only suffixes that begin at anchors are sorted, as far as a window can reach, each followed by the bytes before its
anchor, read backwards. First the blocks exchange the anchors' hashes, and drop the anchors seen in one document alone;
then they exchange the different suffixes of the others, with the smallest document of each, as sorted runs in which
each suffix is coded by the length of the prefix shared with the one before. A key range merges its runs with a loser
tree, and reads off the merged order which windows a smaller document has: a window of x bytes before the anchor is
shared by suffixes between which no common prefix is shorter than width - x, and whose bytes before agree for x.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, arrow_schema, by_range, equal_runs, pack, pack_sorted, unpack, unpack_sorted
from .textkit import mix, prefix_sums, window_hashes
from .workspace import staged

WIDTH, GRAM = 50, 16
#: Bytes of text for each key range.
RANGE_BYTES = 16 << 20
#: Windows whose anchors are searched at a time.
SLICE = 1 << 15
#: A byte that UTF-8 never has: it stands between documents and fills suffixes at their ends.
OUTSIDE = 0xFF


def _sliding(values: np.ndarray, width: int, ufunc: np.ufunc) -> np.ndarray:
    """Extremum of each run of width values."""
    out, span = values, 1
    while span * 2 <= width:
        out = ufunc(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return ufunc(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the lowest grams of all windows that lie inside a document; equal lowest grams all count."""
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = [_anchors(data[a : a + SLICE + width - 1], width, gram) for a in range(0, len(data) - width + 1, SLICE)]
    at = np.concatenate([p + k * SLICE for k, (p, _) in enumerate(found)])
    # windows of two slices can have one anchor
    at, first = np.unique(at, return_index=True)
    return at, np.concatenate([h for _, h in found])[first]


def _anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    grams = window_hashes(prefix_sums(data), gram)
    span = width - gram + 1
    low = _sliding(grams, span, np.minimum)
    outside = np.concatenate([[0], np.cumsum(data == OUTSIDE, dtype=np.int32)])
    low[outside[width:] != outside[: len(data) - width + 1]] = 0
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), span, np.maximum) == grams)
    return at, grams[at]


def suffixes(data: np.ndarray, at: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each anchor the width bytes from it on, and the width - gram bytes before it, backwards; bytes outside its document are OUTSIDE."""
    before = width - gram
    padded = np.concatenate([np.full(before, OUTSIDE, np.uint8), data, np.full(width, OUTSIDE, np.uint8)])
    near = np.lib.stride_tricks.sliding_window_view(padded, before + width)[at]
    out = np.concatenate([near[:, before:], near[:, :before][:, ::-1]], axis=1)
    for part in (out[:, :width], out[:, width:]):
        part[np.maximum.accumulate(part == OUTSIDE, axis=1)] = OUTSIDE
    return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted rows as the lengths of the prefixes shared with the row before, and all that follows those prefixes."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        same = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1)
        shared[1:] = same.sum(axis=1)
    rest = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    return shared, rest.tobytes()


class Run:
    """A front-coded sorted run, read one suffix after the other."""

    def __init__(self, shared: np.ndarray, rest: bytes, size: int):
        self.shared, self.rest, self.size = shared.tolist(), rest, size
        self.next, self.at, self.suffix, self.lcp = 0, 0, b"", 0

    def advance(self) -> bool:
        """Move on; lcp is then the prefix shared with the suffix before in this run."""
        if self.next == len(self.shared):
            return False
        self.lcp = k = self.shared[self.next]
        n = self.size - k
        self.suffix = self.suffix[:k] + self.rest[self.at : self.at + n]
        self.at += n
        self.next += 1
        return True


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of one length, of which `known` bytes are known; those are not read."""
    differs = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (differs.bit_length() + 7) // 8


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, bytes, int]]:
    """(run, suffix, prefix shared with the suffix given before) of all runs in order, by a loser tree.

    Each contender keeps the length of the prefix that it shares with the last winner over it. Of two contenders the one
    that shares more is the smaller, and no byte is read; only at equal lengths are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    done = -1  # an exhausted run: shares nothing, loses to all
    shares = [0] * k
    alive = [r < len(runs) and runs[r].advance() for r in range(k)]
    for r in range(k):
        shares[r] = 0 if alive[r] else done

    def winner(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), both of which have shares with the same earlier suffix; the loser's becomes that with the winner."""
        x, y = shares[a], shares[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a].suffix, runs[b].suffix
        n = common_prefix(s, t, x)
        if a < b if n == len(s) else s[n] < t[n]:
            shares[b] = n
            return a, b
        shares[a] = n
        return b, a

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, lost = winner(build(2 * node), build(2 * node + 1))
        losers[node] = lost
        return w

    top = build(1) if k > 1 else 0
    while shares[top] >= 0:
        run = runs[top]
        yield top, run.suffix, shares[top]
        shares[top] = run.lcp if run.advance() else done
        node = (top + k) // 2
        while node:
            lost = losers[node]
            x, y = shares[top], shares[lost]
            if x == y and x >= 0:
                top, losers[node] = winner(top, lost)
            elif y > x:
                top, losers[node] = lost, top
            node //= 2


def _classes(shared: np.ndarray, depth: int) -> np.ndarray:
    """Numbers that are equal where sorted strings agree for depth bytes, from the prefixes shared with the one before."""
    return np.cumsum(shared < depth)


def smallest_owners(rows: np.ndarray, shared: np.ndarray, smallest: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each different suffix in merged order and each number of bytes before its anchor, the smallest document that has the window; the largest integer where the window leaves the document.

    shared: the prefix that each suffix shares with the one before it.
    """
    before, n = width - gram, len(rows)
    out = np.full((n, before + 1), np.iinfo(np.int64).max)
    left = rows[:, width:]
    wide = np.zeros((n, -(-before // 8) * 8), np.uint8)
    wide[:, :before] = left
    order = np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])
    ordered = left[order]
    left_shared = np.zeros(n, np.int64)
    if n > 1:
        left_shared[1:] = np.logical_and.accumulate(ordered[1:] == ordered[:-1], axis=1).sum(axis=1)
    inside_left, inside_right = (left != OUTSIDE).sum(axis=1), (rows[:, :width] != OUTSIDE).sum(axis=1)
    for x in range(before + 1):
        own = np.flatnonzero((inside_left >= x) & (inside_right >= width - x))
        if not len(own):
            continue
        by_left = np.empty(n, np.int64)
        by_left[order] = _classes(left_shared, x)
        key = (_classes(shared, width - x) * (n + 1) + by_left)[own]
        at = np.argsort(key, kind="stable")
        ordered_key = key[at]
        heads = np.flatnonzero(np.append(True, ordered_key[1:] != ordered_key[:-1]))
        low = np.minimum.reduceat(smallest[own[at]], heads)
        out[own[at], x] = np.repeat(low, np.diff(np.append(heads, len(own))))
    return out


_REPLY = "block bigint, range int, windows binary"


def _merge_range(width: int, gram: int):
    size = 2 * width - gram

    def run(rows: pa.Table) -> pa.Table:
        """Replies to the runs of a range: for each suffix of a run, as bits, its windows that a document smaller than the run's has."""
        read = [{c: rows.column(c)[i].as_py() for c in ("block", "range", "shared", "rest", "lowest")} for i in range(rows.num_rows)]
        runs = [Run(unpack(x["shared"], "u1"), pa.decompress(x["rest"][8:], int.from_bytes(x["rest"][:8], "little"), "zstd", asbytes=True) if len(x["rest"]) > 8 else b"", size) for x in read]
        lowest = [unpack(x["lowest"], "<i8") for x in read]
        heads, taken = [x.tolist() for x in lowest], [0] * len(runs)
        number: list[list[int]] = [[] for _ in runs]
        distinct, smallest, between = [], [], []
        for r, suffix, shared in merge_runs(runs):
            doc = heads[r][taken[r]]
            taken[r] += 1
            if shared == size and distinct:
                if doc < smallest[-1]:
                    smallest[-1] = doc
            else:
                distinct.append(suffix)
                smallest.append(doc)
                between.append(shared)
            number[r].append(len(distinct) - 1)
        table = smallest_owners(np.frombuffer(b"".join(distinct), np.uint8).reshape(-1, size), np.array(between), np.array(smallest, np.int64), width, gram)
        bit = np.uint64(1) << np.arange(width - gram + 1, dtype=np.uint64)
        out = []
        for x, low, m in zip(read, lowest, number, strict=True):
            bits = ((table[np.array(m, np.int64)] < low[:, None]) * bit).sum(axis=1, dtype=np.uint64)
            if bits.any():
                out.append({"block": x["block"], "range": x["range"], "windows": pack(bits)})
        return pa.Table.from_pylist(out, schema=arrow_schema(_REPLY))

    return run


def _seen_twice(rows: pa.Table) -> pa.Table:
    """For each run of anchor hashes which of them are in two documents at least."""
    blocks, range_ = rows.column("block").to_pylist(), rows.column("range")[0].as_py()
    keys = [unpack_sorted(x.as_py()) for x in rows.column("keys")]
    many = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(k)] for x, k in zip(rows.column("many"), keys, strict=True)]
    _, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = np.bincount(at, np.concatenate(many), len(count)) > 0
    live = ((count > 1) | shared)[at]
    ends = np.cumsum([len(k) for k in keys])
    return pa.Table.from_pylist([{"block": b, "range": range_, "live": np.packbits(live[e - len(k) : e]).tobytes(), "n": len(k)} for b, k, e in zip(blocks, keys, ends.tolist(), strict=True)], schema=arrow_schema("block bigint, range int, live binary, n bigint"))


def _content(starts: np.ndarray, buffer: bytes) -> np.ndarray:
    data = np.frombuffer(buffer, np.uint8).copy()
    data[starts[1:] - 1] = OUTSIDE
    return data


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs; with_text adds the remaining bytes, kept.

    A byte goes if a window of `width` bytes over it also starts in a document with a smaller key. Windows are equal if
    their bytes are, within texts, never across two, and judged on the input: what goes from one document still counts
    for the next. Repeats within a document, or among rows with equal keys, remove nothing. A null key counts as smaller
    than any other; a null text as empty; texts shorter than width stay; no rows give no rows.

    Hashes only choose anchors and drop those of one document; which windows are equal is told by bytes. A block sends
    each different suffix once, however often it has it, so what a common passage gives its range is an entry a block.
    """
    if not 24 <= width <= 64 + GRAM:
        raise ValueError("width must be between 24 and 80")
    gram = GRAM
    floor = -(1 << 63)
    blocks = Blocks(docs, key, text, RANGE_BYTES)
    ranges = blocks.ranges
    short = np.uint64(16)  # bits that the exchange of hashes leaves out: chance meetings cost time, not results

    def found(starts: np.ndarray, buffer: bytes) -> tuple[np.ndarray, ...]:
        data = _content(starts, buffer)
        at, hashes = anchors(data, width, gram)
        # an anchor's hash is the lowest of many: mixed again, anchors spread evenly over the ranges
        hashes = mix(hashes)
        return data, at, hashes, np.searchsorted(starts, at, "right") - 1

    def hashes_of(ids: list, starts: np.ndarray, buffer: bytes) -> Iterator[tuple]:
        _, at, hashes, own = found(starts, buffer)
        if not len(at):
            return
        keys = hashes >> short
        order = np.lexsort((own, keys))
        ordered, docs_ = keys[order], own[order]
        heads = np.append(True, ordered[1:] != ordered[:-1])
        group = np.cumsum(heads) - 1
        many = np.zeros(group[-1] + 1, bool)
        many[group[1:][(~heads[1:]) & (docs_[1:] != docs_[:-1])]] = True
        keys = ordered[heads]
        for r, own_ in equal_runs(by_range(keys << short, ranges)):
            yield r, pack_sorted(keys[own_]), np.packbits(many[own_]).tobytes()

    sent = blocks.send(hashes_of, "range int, keys binary, many binary")
    live = staged(sent.groupBy("range").applyInArrow(_seen_twice, "block bigint, range int, live binary, n bigint"), "live")

    def suffixes_of(ids: list, starts: np.ndarray, buffer: bytes, got: pa.Table) -> list[tuple]:
        data, at, hashes, own = found(starts, buffer)
        if not len(at):
            return []
        keys = np.unique(hashes >> short)
        rows = sorted(zip(*(got.column(c).to_pylist() for c in ("range", "live", "n")), strict=True))
        flags = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for _, b, n in rows]).astype(bool)
        keep = flags[np.searchsorted(keys, hashes >> short)]
        at, hashes, own = at[keep], hashes[keep], own[keep]
        if not len(at):
            return []
        block = got.column("block")[0].as_py()
        keys_ = np.array([floor if i is None else i for i in ids], np.int64)[own]
        in_range = by_range(hashes, ranges)
        order = np.argsort(in_range, kind="stable")
        out = []
        for r, part in equal_runs(in_range[order]):
            mine = order[part]
            rows_ = suffixes(data, at[mine], width, gram)
            raw, size = rows_.tobytes(), rows_.shape[1]
            texts = [raw[k : k + size] for k in range(0, len(raw), size)]
            by = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
            rows_, mine = rows_[by], mine[by]
            head = np.flatnonzero(np.append(True, (rows_[1:] != rows_[:-1]).any(axis=1)))
            counts = np.diff(np.append(head, len(rows_)))
            lowest = np.minimum.reduceat(keys_[mine], head)
            shared, rest = front_code(rows_[head])
            # within the block a copy whose document isn't the smallest of its suffix goes whatever others have
            inner = np.packbits(keys_[mine] > np.repeat(lowest, counts)).tobytes()
            out.append((block, r, pack(shared), len(rest).to_bytes(8, "little") + pa.compress(rest, "zstd", asbytes=True), pack(lowest), pack(counts.astype("<u4")), inner, pack(at[mine].astype("<u4"))))
        return out

    runs = staged(blocks.receive(live, suffixes_of, "block bigint, range int, shared binary, rest binary, lowest binary, counts binary, inner binary, places binary"), "runs")
    replies = staged(runs.select("block", "range", "shared", "rest", "lowest").groupBy("range").applyInArrow(_merge_range(width, gram), _REPLY), "windows")
    own_places = runs.select("block", "range", "counts", "inner", "places", F.lit(None).cast("binary").alias("windows"))
    answers = own_places.unionByName(replies, allowMissingColumns=True)

    def cut_out(ids: list, starts: np.ndarray, buffer: bytes, got: pa.Table) -> list[tuple]:
        import hashlib

        n, before = len(buffer), width - gram
        ends = np.append(starts[1:] - 1, n)
        change = np.zeros(n + 1, np.int32)
        windows = {r: w for r, w in zip(got.column("range").to_pylist(), got.column("windows").to_pylist(), strict=True) if w is not None}
        for r, counts, inner, places in zip(*(got.column(c).to_pylist() for c in ("range", "counts", "inner", "places")), strict=True):
            if places is None:
                continue
            at, counts = unpack(places, "<u4").astype(np.int64), unpack(counts, "<u4").astype(np.int64)
            gone = np.flatnonzero(np.unpackbits(np.frombuffer(inner, np.uint8))[: len(at)])
            if len(gone):
                # all windows of the suffix that lie in the document
                doc = np.searchsorted(starts, at[gone], "right") - 1
                np.add.at(change, np.maximum(at[gone] - before, starts[doc]), 1)
                np.add.at(change, np.minimum(at[gone] + width, ends[doc]), -1)
            if r in windows:
                bits = np.repeat(unpack(windows[r], "<u8"), counts)
                some = np.flatnonzero(bits)
                at, bits = at[some], bits[some]
                for x in range(before + 1):
                    a = at[(bits >> np.uint64(x)) & np.uint64(1) > 0] - x
                    np.add.at(change, a, 1)
                    np.add.at(change, a + width, -1)
        gone = np.cumsum(change[:n]) > 0
        data, out = np.frombuffer(buffer, np.uint8), []
        for i, a, b in zip(ids, starts.tolist(), ends.tolist(), strict=True):
            own = gone[a:b]
            removed = int(own.sum())
            kept = data[a:b][~own].tobytes() if removed else buffer[a:b]
            spans = int((np.diff(own.astype(np.int8), prepend=0) == 1).sum()) if removed else 0
            out.append((i, b - a, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        return out

    columns = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return blocks.receive(answers, cut_out, columns).withColumnRenamed("doc_id", key)

"""Texts of Arrow batches as flat byte buffers: words, shingles and hashes computed by numpy over whole buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a piece of its own.
PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(max(n, PIECE + 4096), _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes() hashes any span of data in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power("down", len(sums))[starts] + (ends - starts).astype(np.uint64))


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of a width."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * _power("down", len(sums))[:n])


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, row after the last, their texts joined by newlines, start of each): runs of rows of about limit bytes. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    view = memoryview(data) if data is not None else memoryview(b"")
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        rows = [view[at[i] : at[i + 1]] for i in range(first, last)]
        yield first, last, b"\n".join(rows), at[first:last] - at[first] + np.arange(last - first)
        first = last


def words(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words (runs of bytes outside 0x20 and 0x09-0x0D)."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~SPACE[data]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.searchsorted(doc_starts, starts, "right") - 1


def hashed_words(buffer: bytes, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word of the lower-cased buffer."""
    data = np.frombuffer(buffer.lower(), np.uint8)
    starts, ends, docs = words(data, doc_starts)
    return span_hashes(prefix_sums(data), starts, ends), docs


def shingles(hashes: np.ndarray, docs: np.ndarray, size: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of size words; a document with 1 to size-1 words has its whole sequence as the one shingle."""
    count = np.bincount(docs, minlength=n_docs)
    out, own = [], []
    if len(hashes) >= size:
        n = len(hashes) - size + 1
        value = hashes[:n].copy()
        for k in range(1, size):
            value = mix(value * _BASE + hashes[k : k + n])
        whole = docs[:n] == docs[size - 1 :]
        out.append(value[whole])
        own.append(docs[:n][whole])
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if n_docs else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        value = hashes[first[short]].copy()
        for k in range(1, size):
            more = count[short] > k
            value[more] = mix(value[more] * _BASE + hashes[first[short][more] + k])
        out.append(mix(value ^ count[short].astype(np.uint64)))
        own.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, doc = np.concatenate(out), np.concatenate(own)
    order = np.argsort(doc, kind="stable")
    return value[order], doc[order]


def as_binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())

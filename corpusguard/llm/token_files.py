"""Token ids in Arrow stream files: equal-length sequences and masks as fixed-size lists, open to zero-copy random access."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import SPACE, pieces, prefix_sums, span_hashes, words
from .workspace import new_path, partitions, staged

#: Words that a worker keeps with their ids; the cache starts anew when it is full.
CACHE_WORDS = 2_000_000
#: Bytes of text looked up at a time: so little that what is computed of them stays near the processor.
BUFFER = 1 << 18
#: Bytes of text for each range of ids, and so for each file; with more than MAX_FILES of them, files are larger instead.
FILE_TEXT_BYTES, MAX_FILES = 24 << 20, 16_384
#: Sequences in one record batch.
BATCH_SEQUENCES = 64
FLOOR = -(1 << 63)


def _steps(node: dict | None) -> list[dict]:
    """The single steps of a normalizer in a tokenizer file."""
    if not node:
        return []
    return [s for n in node["normalizers"] for s in _steps(n)] if node["type"] == "Sequence" else [node]


#: Fixed value: the pattern of a pre-tokenizer whose pieces are known apart (see WordCache.parts).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A piece of a word whose characters are all PLAIN: letters, digits and marks of ASCII but < and ', Latin letters with accents, and some marks, which no normal form changes.
PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\\[-`{-~¡«»¿×÷‐-…]+")
_C3, _C2, _DASH = (np.zeros(256, bool) for _ in range(3))
#: Letters (0), digits (1) and other characters (2), by byte.
_KIND = np.full(256, 2, np.uint8)
_KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0xC3], _KIND[0x80:0xC0] = 0, 1, 0, 0
_C3[0x80:0xC0], _C2[[0xA1, 0xAB, 0xBB, 0xBF]], _DASH[0x90:0xA7] = True, True, True


def plain_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 text belong to characters that PLAIN words are made of, and which are to be raised by 32 to lower them."""
    out = data < 0x80
    out &= (data != 0x3C) & (data != 0x27)
    upper = (data >= 0x41) & (data <= 0x5A)
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead < len(data) - 1]
    first, second = data[lead], data[lead + 1]
    latin = (first == 0xC3) & _C3[second]
    two = lead[latin | ((first == 0xC2) & _C2[second])]
    out[two] = out[two + 1] = True
    upper[lead[latin & (second < 0x9F) & (second != 0x97)] + 1] = True
    lead = lead[(first == 0xE2) & (second == 0x80) & (lead < len(data) - 2)]
    three = lead[_DASH[data[lead + 2]]]
    out[three] = out[three + 1] = out[three + 2] = True
    return out, upper


class Growing:
    """An array that values are added to the end of, without copying what it has each time."""

    def __init__(self, dtype: type):
        self.held, self.n = np.zeros(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            larger = np.zeros(max(2 * len(self.held), self.n + len(values)), self.held.dtype)
            larger[: self.n] = self.held[: self.n]
            self.held = larger
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class Spans:
    """Runs of ids, by number."""

    def __init__(self) -> None:
        self.ids, self.first, self.count = Growing(np.uint32), Growing(np.int64), Growing(np.int32)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.first.add(self.ids.n + np.cumsum(counts) - counts)
        self.count.add(counts)
        self.ids.add(ids)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each, one after the other, and where each ends (from 0 on)."""
        count = self.count.held[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.ids.held[np.repeat(self.first.held[at] - ends[:-1], count) + np.arange(ends[-1])], ends


class WordCache:
    """Encodes whole texts with the tokenizers library, each different word once. White space splits words for every
    tokenizer whose pre-tokenizer never joins across it, which the caller vouches for.

    If the tokenizer's file splits by SPLIT alone, composes and lowers letters and marks word ends, words of PLAIN
    characters are looked up in lower case, and by their pieces, so that fewer strings go to the library. The file says
    so, or every word is looked up as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps, split, suffix = _steps(spec.get("normalizer")), spec.get("pre_tokenizer") or {}, spec["model"].get("end_of_word_suffix")
        split = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("behavior"), n.get("invert"), n.get("use_regex"), n.get("add_prefix_space")) for n in split.get("pretokenizers", [])]
        known = [("Split", SPLIT, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        marks = all(t["content"].startswith("<") for t in spec.get("added_tokens", []))
        self.parts = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["content"] == " " and split == known and marks and bool(suffix)
        if self.parts:
            vocabulary = self.library.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            # the same model for pieces, a line each, that need no normal form and no other split
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.no_padding()
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.words = Spans()

    def _whole(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has. All go to the library in one text, a line each; where a token begins tells whose it is."""
        got = self.library.encode("\n".join(lines), add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        begins = np.fromiter((a for a, _ in got.offsets), np.int64, len(ids))
        lengths = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
        owner = np.searchsorted(np.cumsum(lengths), begins, "right")
        return ids, np.bincount(owner, minlength=len(lines))

    def _pieces(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of PLAIN words: each ends with a token that ends a word."""
        ids = np.array(self.plain.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(lines):
            raise RuntimeError("the library splits words in another way than its file says")
        return ids, np.diff(last, prepend=-1)

    def _look_up(self, new: list[bytes]) -> None:
        lines = [w.decode("utf-8") for w in new]
        plain = np.fromiter((PIECE.fullmatch(w) is not None for w in lines), bool, len(lines)) if self.parts else np.zeros(len(lines), bool)
        for own, find in ((np.flatnonzero(plain), self._pieces), (np.flatnonzero(~plain), self._whole)):
            if not len(own):
                continue
            found, counts = find([lines[k] for k in own.tolist()])
            self.words.add(found, counts)
            self.known.update(zip([new[k] for k in own.tolist()], range(len(self.known), len(self.known) + len(own)), strict=True))

    def spans(self, buffer: bytes, starts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(buffer, begins, ends) of what is looked up: words, and PLAIN words in lower case by their pieces.

        The normalizer may compose a letter with a mark after it before it lowers letters; within PLAIN words, and
        before white space or an end, there is nothing to compose. Their pieces are runs of letters, runs of other
        characters, and single digits; words with an apostrophe, at which the pattern has more to say, stay whole.
        """
        data = np.frombuffer(buffer, np.uint8)
        begins, ends, _ = words(data, starts)
        if not self.parts or not len(begins):
            return buffer, begins, ends
        plain, upper = plain_bytes(data)
        odd = np.concatenate([[0], np.cumsum(~plain, dtype=np.int32)])
        clean = odd[ends] == odd[begins]
        inside = np.repeat(clean, ends - begins)
        where = np.flatnonzero(~SPACE[data])[inside]
        out = data.copy()
        out[where] += upper[where].view(np.uint8) << 5
        kind = _KIND[out]
        # the signs among the two-byte characters that PLAIN has
        sign = np.flatnonzero((out[:-1] == 0xC3) & ((out[1:] == 0x97) | (out[1:] == 0xB7)))
        kind[sign] = kind[sign + 1] = 2
        kind[np.flatnonzero(out[:-1] == 0xC2) + 1] = 2
        dash = np.flatnonzero(out[:-2] == 0xE2)
        kind[dash + 1] = kind[dash + 2] = 2
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        held = np.zeros(len(data) + 1, bool)
        held[where] = True
        cut &= held
        cut[begins] = True
        begins = np.flatnonzero(cut[:-1])
        after = np.append(begins[1:], len(data))
        # a piece ends where the next begins, or at its word's end
        word = np.searchsorted(ends, begins, "right")
        return out.tobytes(), begins, np.minimum(after, ends[word])

    def encode(self, buffer: bytes, starts: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a buffer (see pieces()). Words that occur again in the buffer are looked up once: they are told
        apart by two hashes, and all looked up where these disagree."""
        buffer, begins, ends = self.spans(buffer, starts)
        data = np.frombuffer(buffer, np.uint8)
        hashes, others = (span_hashes(prefix_sums(x), begins, ends) for x in (data, data ^ np.uint8(0x5A)))
        _, first, again = np.unique(hashes, return_index=True, return_inverse=True)
        if (others != others[first][again]).any():
            first = again = np.arange(len(begins))
        if len(self.known) > CACHE_WORDS:
            self._clear()
        flat = [buffer[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
        known = self.known
        at = list(map(known.get, flat))
        if None in at:
            missing = [i for i, k in enumerate(at) if k is None]
            self._look_up(list({flat[i] for i in missing}))
            for i in missing:
                at[i] = known[flat[i]]
        at = np.array(at, np.int64)[again]
        ids, upto = self.words.get(at)
        return np.split(ids, upto[np.searchsorted(begins, starts[1:])])


#: One cache for each vocabulary and worker process: later tasks of the process find their words known.
_CACHES: dict[str, WordCache] = {}


def _encoder(path: str, end_id: int, cuts: list[int], dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cuts: the largest keys of all files but the last; a key that fills several files stands there as often, and its rows are dealt to them by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CACHES:
            _CACHES[path] = WordCache(path)
        cache, edges = _CACHES[path], np.array(cuts, np.int64)
        for batch in batches:
            for first, last, buffer, starts in pieces(batch.column(1), BUFFER):
                packed = [np.append(x, np.uint32(end_id)).astype(dtype).tobytes() for x in cache.encode(buffer, starts)]
                keys = batch.column(0).slice(first, last - first)
                plain = keys.fill_null(FLOOR).to_numpy()
                shard = np.searchsorted(edges, plain, "left")
                files = np.searchsorted(edges, plain, "right") - shard
                for i in np.flatnonzero(files > 1).tolist():
                    shard[i] += zlib.crc32(packed[i]) % files[i]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), keys, pa.array(packed, pa.binary())], ["shard", "doc_id", "ids"])

    return run


class SequenceWriter:
    """One Arrow stream file: record batches of (tokens: fixed-size list of unsigned integers, mask: fixed-size list of bytes 0 and 1).

    Ids run on from one sequence into the next; only the last sequence is filled up, with masked zeros. An index file
    beside it has (doc_id, start, n_tokens) of each document.
    """

    def __init__(self, folder: str, name: str, length: int, dtype: str = "<u4"):
        self.fs, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.length, self.dtype = f"{root}/{name}.arrows", length, np.dtype(dtype)
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.uint8(), length))], {"sequence_length": str(length)})
        self.out = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.held, self.held_n, self.total = [], 0, 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= self.length * BATCH_SEQUENCES:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        block = self.length * BATCH_SEQUENCES
        cut = len(flat) if last else len(flat) // block * block
        for a in range(0, cut, block):
            part = flat[a : min(a + block, cut)].astype(self.dtype)
            real = len(part)
            rows = -(-real // self.length)
            part = np.concatenate([part, np.zeros(rows * self.length - real, self.dtype)])
            mask = (np.arange(len(part)) < real).view(np.uint8)
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held, self.held_n = ([flat[cut:]], len(flat) - cut) if cut < len(flat) else ([], 0)

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self.writer.close()
        self.out.close()
        ids, starts, counts = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with self.fs.open_output_stream(f"{self.path}.index") as f, pa.ipc.new_stream(f, index.schema) as w:
            w.write_table(index)
        return self.path, len(self.docs), self.total


class SequenceFile:
    """Random access to a written file. On a local disk it is mapped, and sequences and masks are views without a copy."""

    def __init__(self, path: str, folder: str):
        files = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        reader = pa.ipc.open_stream(source)
        self.length = int(reader.schema.metadata[b"sequence_length"])
        self.batches = list(reader)
        self.flat, self.masks = ([b.column(c).flatten().to_numpy() for b in self.batches] for c in ("tokens", "mask"))
        self.block = self.length * BATCH_SEQUENCES
        with files.open_input_file(f"{path}.index") as f:
            self.index = pa.ipc.open_stream(f).read_all()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and mask of one sequence, both views."""
        b, row = divmod(i, BATCH_SEQUENCES)
        own = slice(row * self.length, (row + 1) * self.length)
        return self.flat[b][own], self.masks[b][own].view(bool)

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ids from a place on: a view if they lie in one batch."""
        parts = []
        while count > 0:
            b, at = divmod(start, self.block)
            part = self.flat[b][at : at + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, length: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, append end_id to each, and write the ids in ascending order of the key; returns the manifest.

    Manifest (a written table): shard, path, folder, n_docs, n_tokens, start (ids in all files before). A null text
    counts as empty and is its end id alone; null keys come first; equal keys stand together, ordered by their ids within a file; no
    rows give no files. Ranges of keys are set from quantiles, one file a range, so that a file has about
    FILE_TEXT_BYTES of text; a task holds one batch of a file, however many documents a range has. A file's name is
    its attempt's own: what a lost executor leaves is in no manifest.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MAX_FILES, max(1, -(-int(total) // FILE_TEXT_BYTES)))
    quantiles = F.percentile_approx(F.coalesce("doc_id", F.lit(FLOOR).cast("long")), [k / n for k in range(1, n)] or [0.5], F.lit(max(10_000, 20 * n)))
    cuts = sorted(rows.agg(quantiles).first()[0] or []) if n > 1 else []
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    encoded = rows.mapInArrow(_encoder(tokenizer, end_id, cuts, dtype), "shard int, doc_id bigint, ids binary")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, shard = None, None

        def done() -> pa.RecordBatch:
            path, n_docs, n_tokens = writer.close()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for s, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if s != shard:
                    if writer:
                        yield done()
                    writer, shard = SequenceWriter(folder, f"part-{s:06d}-{uuid.uuid4().hex[:8]}", length, dtype), s
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), dtype))
        if writer:
            yield done()

    files = staged(dealt.mapInArrow(write, "shard int, path string, n_docs bigint, n_tokens bigint"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumns({"folder": F.lit(folder), "start": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")})


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit) of each document, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = SequenceFile(row["path"], row["folder"])
                starts, counts = (file.index.column(c).to_numpy() for c in ("start", "n_tokens"))
                crc = [zlib.crc32(file.ids(a, c).astype("<u4")) for a, c in zip(starts.tolist(), counts.tolist(), strict=True)]
                table = pa.table({"doc_id": file.index.column("doc_id"), "start": pa.array(starts + row["start"]), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})
                yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    spread = manifest.select("path", "folder", "start").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

"""Documents packed into blocks, and the exchange of sorted runs between blocks and ranges of 64-bit keys.

A block is a row with the texts of some documents. Operators that must look up a great many keys (n-grams, substrings)
let every block send each key range one sorted run instead of a row a key, and get one reply for each run. So a common
key costs each block one entry, and no key range is hot. The blocks are a bucketed table: replies meet their block
without moving a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import pieces
from .workspace import new_path, partitions

BLOCK_BYTES = 2 << 20
#: Bytes of text for each key range.
RANGE_BYTES = 8 << 20
_ZSTD = pa.Codec("zstd", compression_level=3)


def pack(values: np.ndarray) -> bytes:
    """Compressed integers, byte planes apart; sorted values should come as differences."""
    raw = np.ascontiguousarray(values)
    width = raw.dtype.itemsize
    planes = raw.view(np.uint8).reshape(-1, width).T.tobytes()
    return len(planes).to_bytes(8, "little") + (bytes(_ZSTD.compress(planes)) if planes else b"")


def unpack(data: bytes, dtype: str) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(_ZSTD.decompress(memoryview(data)[8:], n), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for first, last, buffer, starts in pieces(batch.column(1), BLOCK_BYTES):
            ids = batch.column(0).slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([starts.astype(np.int64).tobytes()], pa.binary()), pa.array([buffer], pa.binary())], ["block", "ids", "starts", "body"]
            )
            number += 1


class Blocks:
    """The blocks of a table of documents (key: integers), written as a bucketed table of the session's warehouse."""

    def __init__(self, docs: DataFrame, key: str, text: str, range_bytes: int = RANGE_BYTES):
        spark = docs.sparkSession
        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.ranges = max(1, -(-int(total) // range_bytes))
        self.name = f"corpusguard_blocks_{uuid.uuid4().hex[:12]}"
        made = rows.mapInArrow(_blocks, "block bigint, ids array<bigint>, starts binary, body binary")
        made.write.option("compression", "zstd").option("path", new_path(spark, "blocks")).bucketBy(partitions(spark), "block").saveAsTable(self.name)
        self.table = spark.table(self.name)
        # the plan has the files and their buckets; the entry in the catalogue is needed no more
        spark.sql(f"DROP TABLE {self.name}")

    def send(self, run: Callable, columns: str) -> DataFrame:
        """What run(ids, starts, buffer) yields for each block: (range, payload, ...) as columns: rows block, range, ...."""
        names = [c.split()[0] for c in columns.split(",")]

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(len(batch)):
                    block, ids, starts, body = (batch.column(c)[row] for c in ("block", "ids", "starts", "body"))
                    rows = list(run(ids.as_py(), np.frombuffer(starts.as_py(), np.int64), body.as_py()))
                    if rows:
                        yield pa.RecordBatch.from_pylist([{"block": block.as_py(), **dict(zip(names, r, strict=True))} for r in rows], schema=arrow_schema(f"block bigint, {columns}"))

        return self.table.mapInArrow(emit, f"block bigint, {columns}")

    def receive(self, replies: DataFrame, merge: Callable, columns: str) -> DataFrame:
        """merge(ids, starts, buffer, replies of the block as a table) yields rows of columns."""
        names = [c.split()[0] for c in columns.split(",")]
        schema = arrow_schema(columns)

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for row in range(left.num_rows):
                ids, starts, body = (left.column(c)[row].as_py() for c in ("ids", "starts", "body"))
                out += merge(ids, np.frombuffer(starts, np.int64), body, right)
            return pa.table([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*out, strict=True))], schema=schema) if out else schema.empty_table().select(names)

        return self.table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(both, columns)


def arrow_schema(columns: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(",")])


def by_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit key; sorted keys have sorted ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def equal_runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array, and where it stands."""
    if len(values):
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(values)], strict=True):
            yield int(values[a]), slice(a, b)

"""Exact deduplication: static binary-fuse filters of immutable snapshots screen the digests of an incoming batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import mix
from .workspace import lookup, new_path, partitions, staged

#: Digests in one filter; a snapshot has as many filters as it needs.
FILTER_KEYS = 250_000
#: What a null key counts as.
FLOOR = -(1 << 63)
#: Largest table of groups that is broadcast to the byte check.
BROADCAST_BYTES = 64 << 20


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, one in each of three neighbouring segments, and its 8-bit fingerprint."""
    h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first.astype(np.int64) * segment
    g = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    low = np.uint64(segment - 1)
    at = np.stack([base + (g & low).astype(np.int64), base + segment + ((g >> np.uint64(20)) & low).astype(np.int64), base + 2 * segment + ((g >> np.uint64(40)) & low).astype(np.int64)])
    return at, (mix(g) & np.uint64(0xFF)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> bytes:
    """A static binary-fuse filter of distinct 64-bit keys: no false negative, about 1/256 false positives, 9-10 bits a key."""
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
    for seed in range(1, 400):
        segments = max(1, -(-room // segment) - 2)
        size = (segments + 2) * segment
        at, prints = _slots(keys, seed, segment, segments)
        # peel in rounds: every slot that a single unpeeled key uses takes that key off
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        alive = np.ones(n, bool)
        peeled: list[tuple[np.ndarray, np.ndarray]] = []
        single = np.flatnonzero(degree == 1)
        while len(single):
            key, where = np.unique(owner[single], return_index=True)
            slot = single[where]
            peeled.append((key, slot))
            alive[key] = False
            for row in at:
                np.subtract.at(degree, row[key], 1)
                np.bitwise_xor.at(owner, row[key], key)
            touched = np.unique(at[:, key])
            single = touched[degree[touched] == 1]
        if not alive.any():
            table = np.zeros(size, np.uint8)
            for key, slot in reversed(peeled):
                a, b, c = (table[row[key]] for row in at)
                table[slot] ^= prints[key] ^ a ^ b ^ c
            return np.array([seed, segment, segments], np.int64).tobytes() + table.tobytes()
        room += room // 50 + 1
    raise RuntimeError("no binary-fuse filter was found")


def in_fuse(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    seed, segment, segments = (int(x) for x in np.frombuffer(filter_, np.int64, 3))
    table = np.frombuffer(filter_, np.uint8, offset=24)
    at, prints = _slots(keys, seed, segment, segments)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == prints


def _keys_of(digests: pa.Array) -> np.ndarray:
    """The first 8 bytes of each 32-byte digest."""
    return np.frombuffer(b"".join(x[:8] for x in digests.to_pylist()), ">u8").astype(np.uint64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter for each bucket; a bucket's rows arrive together, sorted by it."""
    held: list[np.ndarray] = []
    bucket = None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([build_fuse(np.unique(np.concatenate(held)))], pa.binary())], ["bucket", "filter"])

    for batch in batches:
        ids, keys = batch.column(0).to_numpy(), _keys_of(batch.column(1))
        cuts = np.flatnonzero(np.diff(ids)) + 1
        for part_ids, part in zip(np.split(ids, cuts), np.split(keys, cuts), strict=True):
            if not len(part):
                continue
            if bucket is not None and part_ids[0] != bucket:
                yield made()
                held = []
            bucket = int(part_ids[0])
            held.append(part)
    if held:
        yield made()


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests that their bucket's filter lets through. Each bucket's filter row sorts before its digests."""
    bucket, filter_ = None, b""
    for batch in batches:
        ids, filters, digests = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        probe = digests.is_valid().to_numpy(zero_copy_only=False)
        keep = np.zeros(len(batch), bool)
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | np.diff(probe)) + 1, [len(ids)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if not probe[a]:
                bucket, filter_ = int(ids[b - 1]), filters[int(b - 1)].as_py()
            elif ids[a] == bucket:
                keep[a:b] = in_fuse(filter_, _keys_of(digests.slice(a, b - a)))
        if keep.any():
            yield pa.RecordBatch.from_arrays([digests.filter(pa.array(keep))], ["digest"])


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


class Snapshot:
    """An immutable set of digests: its index (digest, top id, size) and its filters, both written tables."""

    def __init__(self, spark: SparkSession, path: str):
        """The snapshot saved under a path."""
        self.index, self.filters = spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/filters")
        self.buckets = spark.read.parquet(f"{path}/buckets").first()["buckets"]

    @classmethod
    def save(cls, rows: DataFrame, path: str | None = None) -> Snapshot:
        """Build and write the snapshot of rows (digest, id); without a path it lasts as long as the driver."""
        spark = rows.sparkSession
        path = path or new_path(spark, "snapshot")
        rows.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("size")).write.parquet(f"{path}/index")
        index = spark.read.parquet(f"{path}/index")
        buckets = max(1, -(-index.count() // FILTER_KEYS))
        keyed = index.select(_bucket(F.col("digest"), buckets).alias("bucket"), "digest")
        keyed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_build, "bucket int, filter binary").write.parquet(f"{path}/filters")
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/buckets")
        return cls(spark, path)

    def screen(self, digests: DataFrame) -> DataFrame:
        """Those of the distinct digests that may be in the snapshot: filters and digests meet by bucket, nothing is broadcast."""
        asked = digests.select(_bucket(F.col("digest"), self.buckets).alias("bucket"), F.lit(None).cast("binary").alias("filter"), "digest")
        both = self.filters.select("bucket", "filter", F.lit(None).cast("binary").alias("digest")).unionByName(asked)
        dealt = both.repartition(partitions(digests.sparkSession), "bucket").sortWithinPartitions("bucket", F.col("digest").isNotNull())
        return dealt.mapInArrow(_screen, "digest binary")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """digest and id of each row, as snapshots are made of; a null text counts as empty, a null key is the smallest."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), F.coalesce(F.col(key), F.lit(FLOOR).cast("long")).alias("id"))


def group_copies(docs: DataFrame, in_snapshot: Column | None = None, key: str = "doc_id", text: str = "text", snapshots: Sequence[Snapshot] = ()) -> DataFrame:
    """For each row of docs: key, keep_id, group_size, kept, text_sha256, and known (its text is in a snapshot).

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the largest key
    stays; a null key is smaller than any other, and of rows that share the largest key all are marked kept (the key
    can't tell them apart). An empty table gives no rows; other columns of docs don't matter.

    Rows are either of a new batch, or of the earlier snapshot that in_snapshot tells from it (default: even hashes of
    the key); or all are of the new batch, and `snapshots` saved before are given: their members count in group_size,
    and the largest key can be one of theirs. The new batch's own copies are grouped first; its distinct digests then
    pass each snapshot's binary-fuse filters; those let through meet the exact digests, and every member of a group is
    compared, byte by byte, with the text of the row that stays, if that is among docs. A digest whose texts differ
    would be an error of SHA-256, and stops the job.
    """
    if in_snapshot is None:
        in_snapshot = F.lit(False) if snapshots else F.pmod(F.xxhash64(F.col(key)), F.lit(2)) == 0
    body = F.coalesce(F.col(text), F.lit(""))
    floor = F.lit(FLOOR).cast("long")
    hashed = staged(docs.select(F.col(key), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), in_snapshot.alias("old")), "digests")
    ids = hashed.select("digest", "old", F.coalesce(F.col(key), floor).alias("id"))
    batch = ids.filter(~F.col("old")).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("size"))
    groups = batch.withColumn("old", F.lit(False))
    own = [] if snapshots else [Snapshot.save(ids.filter("old").select("digest", "id"))]
    for snapshot in [*own, *snapshots]:
        positive = snapshot.screen(batch.select("digest"))
        # every row of docs needs its group; of a snapshot of other rows only what the batch meets is wanted
        met = snapshot.index if own else positive.join(snapshot.index, "digest")
        if own:
            met = positive.join(met, "digest").select("digest", "top", "size").unionByName(met.join(positive, "digest", "left_anti"))
        groups = groups.unionByName(met.select("digest", "top", "size", F.lit(True).alias("old")))
    groups = groups.groupBy("digest").agg(F.max("top").alias("keep"), F.sum("size").alias("group_size"), F.max("old").alias("met"))
    copies = staged(groups.filter("group_size > 1"), "copies")
    verify_bytes(docs.select(F.coalesce(F.col(key), floor).alias("id"), body.alias("text")), copies.select("digest", "keep", "group_size"))
    found = lookup(hashed, copies, "digest", "group_size", hashed.count(), nulls=False)
    keep = F.when(F.col("keep").isNull(), F.col(key)).otherwise(F.nullif(F.col("keep"), floor))
    return found.select(
        key,
        keep.alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col(key)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.coalesce("met", "old").alias("known"),
    )


def verify_bytes(rows: DataFrame, copies: DataFrame) -> None:
    """Compare the text of each row (id, text) of a group with that of the group's kept row; raises if bytes differ.

    While the groups (digest, keep, group_size) are few enough to broadcast, texts in no group aren't shuffled. A kept
    text is copied to as many salts as its group has thousands of rows, so no task compares a whole large group.
    """
    wanted = copies.select("digest", "keep", "group_size")
    hashed = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    n_groups = copies.count()
    if n_groups * 128 <= BROADCAST_BYTES:
        members = hashed.join(F.broadcast(wanted), "digest")
    else:
        members = lookup(hashed, wanted, "digest", "group_size", rows.count(), nulls=False).filter("keep is not null")
    salts = F.ceil(F.col("group_size") / 1000).cast("int")
    members = members.select("digest", "id", "text", "keep", salts.alias("salts"))
    kept = members.filter("id = keep").dropDuplicates(["digest"]).select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("kept_text"))
    asked = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    if asked.join(kept, ["digest", "salt"]).filter("text <> kept_text").limit(1).count():
        raise RuntimeError("texts of one SHA-256 digest differ")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns; see group_copies(). A key goes if none of its rows stays; rows with a null key count as one key's."""
    gone = group_copies(docs, None, key, text).groupBy(F.col(key).alias("_gone")).agg(F.max("kept").alias("_kept")).filter("not _kept")
    return docs.join(gone.select("_gone"), F.col(key).eqNullSafe(F.col("_gone")), "left_anti")

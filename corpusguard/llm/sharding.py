"""Sharding by rendezvous hashing of stable record keys over weighted shards (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import staged

#: Sub-ranges of a shard within which slots are counted; a shard is never sorted as a whole.
SUBRANGES = 256


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard of a key: the largest -w/ln(u) over the shards, u a hash of key and shard in (0, 1); ties go to the lower shard.

    A shard's bid depends on the key and that shard alone, so adding a shard moves only the keys that it wins, and a
    shard of weight 0 gets nothing.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")
    bids = []
    for shard, weight in enumerate(weights):
        if weight == 0:
            continue
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        bids.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("bid"), F.lit(-shard).alias("shard")))
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    return (-best["shard"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", seed: int = 0, subranges: int = SUBRANGES) -> DataFrame:
    """Deal the rows of docs to shards and number them in each shard without gaps.

    Returns key, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot and grown_shard (the shard under
    the weights `grown`; null without them). The key alone decides, so rows with equal keys (and all rows with a null
    key, which count as one key) share a shard; each still gets a slot of its own. A null text has the size and
    checksum of an empty one; an empty table gives no rows; other columns of docs are ignored.

    Slots: rows are counted by (shard, subrange of the hash of key and text, so that rows of one key don't meet), the counts are summed up within the shard, and each
    subrange is numbered by itself. So no task holds a shard; the broadcast table has len(weights) * subranges rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    stable = F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(stable, weights, seed).alias("shard"),
        (rendezvous(stable, grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(stable, F.col(text), F.lit(seed + 1)), F.lit(subranges)).cast("int").alias("_sub"),
    )
    rows = staged(rows, "shards")
    counts = rows.groupBy("shard", "_sub").count()
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_sub").orderBy(F.col(key), "text_crc32", "size")
    return rows.join(F.broadcast(starts), ["shard", "_sub"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.row_number().over(within) - 1).cast("long").alias("slot"), "grown_shard"
    )

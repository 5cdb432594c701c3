"""Sharding by jump consistent hashing, with DataFrame functions only.

No ring table: a key's shard follows from the key and the number of shards, and one more
shard draws only its own share of the keys, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from .common import keep, numbered

#: Fixed values of the published algorithm: x -> x * 2862933555777941757 + 1 modulo 2^64.
_FACTOR = 2862933555777941757
_LOW32 = (1 << 32) - 1


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """One step of the generator on a 64-bit state in two halves, each partial product below 2^49."""
    fh, fl = F.lit(_FACTOR >> 32), F.lit(_FACTOR & _LOW32)

    def times(x: Column, y: Column) -> Column:  # x * y modulo 2^32
        return (x.bitwiseAND(F.lit(0xFFFF)) * y + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW32))

    upper = F.shiftright(low, 16) * fl
    sum_ = low.bitwiseAND(F.lit(0xFFFF)) * fl + 1 + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(sum_, 32) + F.shiftright(upper, 16)
    return (carry + times(high, fl) + times(low, fh)).bitwiseAND(F.lit(_LOW32)), sum_.bitwiseAND(F.lit(_LOW32))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 .. shards - 1) of a 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be positive")

    def step(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        jump = F.floor((state["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1))).cast("long")
        more = state["j"] < shards
        return F.struct(
            F.when(more, high).otherwise(state["high"]).alias("high"),
            F.when(more, low).otherwise(state["low"]).alias("low"),
            F.when(more, state["j"]).otherwise(state["b"]).alias("b"),
            F.when(more, jump).otherwise(state["j"]).alias("j"),
        )

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_LOW32)).alias("low"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    # each step lets j grow, so it passes `shards` after that many at most
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, size, text_crc32, shard, slot, grown_shard.

    The shard depends on doc_id and the number of shards only; a null doc_id is a key like
    others.  size is the UTF-8 length plus 1, a null text counting none; slot numbers the
    rows of a shard from 0 without gaps, ordered by key hash, doc_id, checksum and size (from
    one sort by ranges, so a key that a third of the rows hold is split); repeated rows get
    one shard and different slots; a very long text is a size like others; grown_shard is the shard with one
    shard more; an empty table gives no rows; other columns of docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = keep(
        docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .withColumn("key", F.xxhash64("doc_id"))
        .withColumn("shard", jump_hash(F.col("key"), shards))
        .withColumn("grown_shard", jump_hash(F.col("key"), shards + 1))
        .withColumn("row", F.monotonically_increasing_id()),  # tells equal rows apart; written, so it does not change
        "shards",
    )
    placed = numbered(rows, "shard", "key", "doc_id", "text_crc32", "size", "row")
    begins = rows.groupBy("shard").agg(F.count("*").alias("n"))
    ahead = begins.alias("a").join(begins.alias("b"), F.col("b.shard") < F.col("a.shard"), "left").groupBy("a.shard").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(ahead), "shard").select(  # a row for each shard
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - 1 - F.col("before")).cast("long").alias("slot"), "grown_shard"
    )

"""Assignment of rows to shards by jump consistent hashing, with DataFrame functions only.

Lamping and Veach's method needs no table of the ring: a linear congruential generator seeded by the key gives an increasing
sequence of shard numbers, and the last one below the shard count is the key's shard. The sequence doesn't depend on the
count, so one more shard takes its share of rows from all others and moves nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Multiplier of the published generator, and 2 to the powers 64, 54, 33 and 31.
MULTIPLIER = 2862933555777941757
TWO_64, TWO_54, TWO_33, TWO_31 = 18446744073709551616, 18014398509481984, 8589934592, 2147483648.0


def _big(value: int) -> Column:
    return F.expr(f"CAST({value} AS DECIMAL(38,0))")


def _state(key: Column) -> Column:
    """The key as an unsigned 64-bit number; a null key counts as 0."""
    return F.pmod(F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(38,0)"), _big(TWO_64)).cast("decimal(20,0)")


def _next(state: Column) -> Column:
    return ((state * F.expr(f"CAST({MULTIPLIER} AS DECIMAL(18,0))" if MULTIPLIER < 10**18 else f"CAST({MULTIPLIER} AS DECIMAL(19,0))") + F.lit(1)) % _big(TWO_64)).cast("decimal(20,0)")


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key (int)."""

    def step(acc: Column, _: Column) -> Column:
        state = _next(acc["state"])
        share = F.lit(TWO_31) / (F.floor(state / _big(TWO_33)).cast("double") + 1)
        return F.when(acc["jump"] >= shards, acc).otherwise(F.struct(state.alias("state"), acc["jump"].alias("shard"), F.floor((acc["jump"] + 1) * share).cast("long").alias("jump")))

    start = F.struct(_state(key).alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("jump"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["shard"]).cast("int")


def shard(docs: DataFrame, shards: int, key: str = "doc_id", slot_buckets: int = 1024) -> DataFrame:
    """Each row with ``shard``, ``grown_shard`` (of shards + 1) and a gapless ``slot`` in its shard.

    Columns out: key, size, text_crc32, shard, slot, grown_shard. A null text has no bytes; a null key counts as 0. Repeated
    rows share a shard and get a slot each. Slots are numbered in two levels so that no task holds a shard: shards are cut
    into slot_buckets by a hash of the key, rows are numbered in their bucket, and the counts of the buckets before (at most
    shards * slot_buckets rows, whatever the input) are added.
    """
    id_ = F.coalesce(F.col(key).cast("long"), F.lit(0))
    bucket = F.floor(_next(_state(F.col(key))) / _big(TWO_54)).cast("long") % slot_buckets
    keyed = docs.select(F.col(key), id_.alias("__id"), jump_hash(id_, shards).alias("shard"), bucket.alias("__bucket"))
    counts = keyed.groupBy("shard", "__bucket").count()
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(key), id_.alias("__id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_hash(id_, shards).alias("shard"), bucket.alias("__bucket"),
    )
    here = Window.partitionBy("shard", "__bucket").orderBy("__id", "text_crc32", "size")
    numbered = rows.withColumn("__at", F.row_number().over(here)).join(offsets, ["shard", "__bucket"])
    return numbered.select(key, "size", "text_crc32", "shard", (F.col("__before") + F.col("__at") - 1).cast("long").alias("slot"), jump_hash(F.col("__id"), shards + 1).alias("grown_shard"))

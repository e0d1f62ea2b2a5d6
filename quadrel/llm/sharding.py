"""Sharding by a permutation-filled lookup table (operator 4); DataFrame functions only.

Each shard has a preference order over the slots of a prime-sized table (an offset and a
skip from its name's hash). Shards take turns, each claiming its next free slot, until the
table is full. Documents hash to slots, and a broadcast join with the table, whose size is a
parameter and not a function of the data, gives the shard. Removing a shard moves few others'
slots.

Defined cases: a null key hashes as the empty string; empty and very long keys are hashed whole; equal
keys, and so repeated rows, go to one shard; columns of the input are kept, clashing names (``slot``,
``shard``) are replaced; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Production parameters: shards, and the prime number of slots, a thousand times as many.
SHARDS, SLOTS = 64, 65_537


def fill(names: list[str], slots: int) -> list[int]:
    """Shard index of each slot. Its cost is that of the table; no data is seen."""
    if not names:
        raise ValueError("no shards")
    if slots < max(2, len(names)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, at least the number of shards")
    order = []
    for name in names:
        h = hashlib.md5(name.encode()).digest()
        order.append((int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1))
    at, table, taken = [0] * len(names), [-1] * slots, 0
    while taken < slots:
        for shard, (offset, skip) in enumerate(order):
            slot = (offset + at[shard] * skip) % slots
            while table[slot] >= 0:
                at[shard] += 1
                slot = (offset + at[shard] * skip) % slots
            table[slot] = shard
            at[shard] += 1
            taken += 1
            if taken == slots:
                break
    return table


def lookup(spark: SparkSession, names: list[str], slots: int) -> DataFrame:
    """slot, shard: the filled table as a DataFrame of ``slots`` rows."""
    packed = ",".join(map(str, fill(names, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(packed), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key, slots: int):
    """Slot of a key: the first 15 hex digits of its md5 as a number, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def shard(df: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """df with ``slot`` and ``shard``: no shuffle, one broadcast of a table of fixed size."""
    names = names or [f"shard-{i:03d}" for i in range(SHARDS)]
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(lookup(df.sparkSession, names, slots)), "slot")


def write_shards(df: DataFrame, path: str, key: str, names: list[str] | None = None, slots: int = SLOTS, pieces: int = 8) -> None:
    """One folder a shard. Each shard is dealt over ``pieces`` tasks by slot, so a large one isn't one task's work."""
    out = shard(df, key, names, slots)
    count = len(names or range(SHARDS)) * pieces
    out.repartition(count, "shard", F.pmod(F.col("slot"), F.lit(pieces))).write.partitionBy("shard").parquet(path)

"""Shard placement by a permutation-filled lookup table. DataFrame functions only on the data path.

Every shard has an own order of preference over the slots of a prime-sized table: it starts at one
slot and steps by a fixed stride, which visits all slots as the size is prime. The shards take turns to
claim the first free slot of their order until the table is full. A key hashes to a slot, the slot names
the shard. When a shard leaves, few keys of other shards move.

The table depends on the shard names alone, never on the data; it is made on the driver and has at most
``MAX_SLOTS`` entries, which bounds the broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import free_name

SLOTS = 65_537
MAX_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """First slot and stride of a shard."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> position of the shard in ``names``."""
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shard names must be distinct, one at least and no more than slots")
    if not is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime number up to {MAX_SLOTS}")
    turns = [preference(name, slots) for name in names]
    at = [start for start, _ in turns]
    table, free = [-1] * slots, slots
    while True:
        for shard, (_, stride) in enumerate(turns):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + stride) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: one row per slot."""
    listed = F.lit(",".join(map(str, fill(names, slots))))
    pairs = spark.range(1).select(F.posexplode(F.split(listed, ",")).alias("slot", "shard"))
    return pairs.select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text; a null key counts as empty text."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: Column, names: list[str], slots: int = SLOTS, out: str = "shard") -> DataFrame:
    """``df`` with the shard (position in ``names``) of each row; a column of that name is replaced.

    Every row gets a shard, null keys included; equal keys get the same one. No shuffle: the table is broadcast.
    """
    slot = free_name(df, "slot")
    placed = df.withColumn(slot, slot_of(key, slots)).drop(out)
    owners = lookup_table(df.sparkSession, names, slots).select(F.col("slot").alias(slot), F.col("shard").alias(out))
    return placed.join(F.broadcast(owners), slot, "left").drop(slot)


def write_shards(placed: DataFrame, path: str, out: str = "shard") -> None:
    """One folder per shard; a shard that takes many rows is split over several files."""
    placed.hint("rebalance", out).write.partitionBy(out).parquet(path)

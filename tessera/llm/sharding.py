"""Sharding by a permutation-filled lookup table (DataFrame operations only for the rows)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime well above 100 times the shards keeps their shares within a percent or so.
SLOTS = 65_537
SHARDS = 256


def _number(text: str, part: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[15 * part : 15 * part + 15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """slots entries, each the index of the shard that owns it.

    Every shard has its own order of all slots (offset + i * skip modulo the prime); they take turns, each claiming its
    next free slot, so that shares differ by one slot at most, and few slots move when a shard comes or goes.
    """
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and at most slots")
    at = [_number(s, 0) % slots for s in shards]
    skip = [_number(s, 1) % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its md5's first 60 bits modulo the prime. A null key is the empty one."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def _owners(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot_no, shard): the table as rows; as many as slots, so it can be broadcast whatever is placed."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    rows = spark.range(1).select(F.posexplode(owners).alias("slot_no", "owner"))
    return rows.select("slot_no", F.element_at(F.array(*map(F.lit, shards)), F.col("owner").cast("int") + 1).alias("shard"))


def place(df: DataFrame, shards: list[str], key_col: str, slots: int = SLOTS) -> DataFrame:
    """df's key column with (slot, shard): a lookup in the table, which is broadcast.

    No shuffle: each row is placed where it is. Equal keys get equal shards, null keys that of the empty key; other
    columns don't matter. A key of any length counts by its md5.
    """
    keyed = df.select(F.col(key_col), slot_of(F.col(key_col), slots).alias("__slot"))
    owners = F.broadcast(_owners(df.sparkSession, shards, slots).withColumnRenamed("shard", "__shard"))
    return keyed.join(owners, F.col("__slot") == F.col("slot_no")).select(F.col(key_col), F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def write_shards(df: DataFrame, path: str, shards: list[str], key_col: str, files: int = 8, slots: int = SLOTS) -> None:
    """All columns of df as Parquet, a folder shard_name=... for each shard, with `files` tasks to a shard, so that none holds a whole one."""
    owners = F.broadcast(_owners(df.sparkSession, shards, slots).withColumnsRenamed({"slot_no": "__slot_no", "shard": "shard_name"}))
    placed = df.join(owners, slot_of(df[key_col], slots) == F.col("__slot_no")).drop("__slot_no")
    placed.repartition("shard_name", F.pmod(F.xxhash64(df[key_col]), F.lit(files))).write.mode("overwrite").partitionBy("shard_name").parquet(path)

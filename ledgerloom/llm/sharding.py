"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own, a permutation
given by an offset and a skip. Shards take turns; at its turn a shard claims the first
slot of its order that is free. A key is placed by one hash and one look-up, and when a
shard leaves or joins, few keys move.

Defined results: null keys hash like the empty string; repeated keys share a shard; an
empty table gives an empty result; extra columns pass through assign().
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime: at 64 shards, each one's share of the slots is even to within one slot.
TABLE_SIZE = 65_537


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard that owns each slot. size is prime and exceeds the shards."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than the slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    nexts, skips = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        nexts.append(int.from_bytes(digest[:8], "big") % size)
        skips.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    table, left = [-1] * size, size
    while True:
        for shard, skip in enumerate(skips):
            slot = nexts[shard]
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot], nexts[shard] = shard, (slot + skip) % size
            left -= 1
            if not left:
                return table


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard, shard_name): exactly size rows, which bounds what assign() broadcasts."""
    filled = fill_table(shards, size)
    return spark.createDataFrame([(slot, s, shards[s]) for slot, s in enumerate(filled)], "slot int, shard int, shard_name string")


def assign(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with shard_slot, shard and shard_name. The broadcast holds size rows, however large df is. Columns of df that have
    these names stay as given_shard_slot, given_shard and given_shard_name."""
    slot = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")
    own = {"shard_slot", "shard", "shard_name"}
    df = df.withColumn("_given_slot", slot).withColumnsRenamed({c: f"given_{c}" for c in df.columns if c in own}).withColumnRenamed("_given_slot", "shard_slot")
    table = table_frame(df.sparkSession, shards, size).select(F.col("slot").alias("shard_slot"), "shard", "shard_name")
    return df.join(F.broadcast(table), "shard_slot")


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, size: int = TABLE_SIZE) -> None:
    """Writes df as Parquet under path/shard=N. Rows are rebalanced by shard, so a shard of any size takes as many tasks, and
    files, as its bytes need."""
    placed = assign(df, key, shards, size)
    placed.hint("rebalance", "shard").write.partitionBy("shard").mode("overwrite").parquet(path)

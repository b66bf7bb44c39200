"""Sharding by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table; the shards take turns, and each turn claims
the next free slot of that walk. Placement is then one hash and one lookup. Slots are shared evenly (counts differ by
at most one), and when a shard comes or goes few other slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Slots of the table; a prime well over 100 times the number of shards.
SLOTS = 65_537
SHARDS = 64


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot. `slots` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be different names, one at least")
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime no smaller than the number of shards")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    filled = 0
    while filled < slots:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            filled += 1
            if filled == slots:
                break
    return owner


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot and shard of each row, by the hash of its key columns.

    Nulls hash as nulls, so rows with equal keys, null ones included, share a shard. Columns of df named slot or shard
    are replaced. The table that is broadcast has `slots` rows, whatever the size of df.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, slots)
    owners = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "slot int, shard string")
    keyed = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))
    return keyed.join(F.broadcast(owners), "slot").select(*[F.col(f"`{c}`") for c in keyed.columns if c != "slot"], "slot", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, ["doc_id"], [f"shard-{i:03d}" for i in range(SHARDS)])

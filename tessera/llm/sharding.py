"""Sharding by a permutation-filled lookup table.

Each shard has an offset and a skip, hence a permutation of a prime number of
slots; shards take turns claiming the first free slot in their own order until
the table is full. A row's slot is its key's hash modulo the table size, and a
broadcast of the table (``table_size`` rows, fixed whatever the data) places it
in constant time with no shuffle. Removing a shard moves few rows of the others.

Defined results: a null key is placed as the key ``\\0``; equal keys go to one
shard; all input rows come back, with all columns except those named like the
two added ones; an empty table gives an empty result. Column names may hold dots; ``key`` is a name, not a path.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, some thousand slots for each shard: shares differ by under 0.1 %.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: tuple[str, ...] | list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """Slot -> index into ``shards``. A shard of weight w takes w turns a round."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime not below the number of shards")
    starts = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        starts.append((int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1))
    turns = [max(1, (weights or {}).get(s, 1)) for s in shards]
    table, at, filled = [-1] * size, [0] * len(shards), 0
    while True:
        for i, (offset, skip) in enumerate(starts):
            for _ in range(turns[i]):
                while table[slot := (offset + at[i] * skip) % size] >= 0:
                    at[i] += 1
                table[slot] = i
                at[i] += 1
                filled += 1
                if filled == size:
                    return table


def table_frame(spark: SparkSession, shards: tuple[str, ...] | list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """The lookup table as rows (slot, shard), built from two literals."""
    ids = F.split(F.lit(",".join(map(str, fill_table(shards, size, weights)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    rows = spark.range(1).select(F.posexplode(ids).alias("slot", "i"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("i").cast("int")).alias("shard"))


def place(df: DataFrame, key: str, shards: tuple[str, ...] | list[str] = SHARDS, size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard``."""
    digest = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0")).cast("binary"))
    slot = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % size
    others = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    rows = df.select(*(F.col(f"`{c}`") for c in others), slot.alias("slot"))
    # Broadcast is safe: the table has `size` rows, a parameter, not a function of the data.
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, size, weights)), "slot", "left").select(*(F.col(f"`{c}`") for c in others), "slot", "shard")

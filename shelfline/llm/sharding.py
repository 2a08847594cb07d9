"""Placement of rows on shards through a permutation-filled look-up table.

Every shard prefers the slots of a prime-sized table in an order of its own, a
permutation that an offset and a step give.  The shards take turns; each claims
the first free slot of its order, until no slot is left.  A row goes to the
shard that holds slot ``hash(key) mod size``.  Each shard gets a slot more or
less than the others, and adding or removing one moves few slots of the rest.

The table has ``size`` entries whatever the data are (65,537 by default, 200 KB),
so it is sent along as a literal.  Placement is one column expression per row:
no shuffle, no join, no skew.  A null key has the hash of ''; equal keys share a
shard; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, functions as F

TABLE_SIZE = 65_537


def _seed(name: str, use: str) -> int:
    return int(hashlib.md5(f"{use}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    if size < 2 or any(size % d == 0 for d in range(2, math.isqrt(size) + 1)):
        raise ValueError("the table size must be prime")
    at = [_seed(s, "offset") % size for s in shards]
    step = [_seed(s, "step") % (size - 1) + 1 for s in shards]
    table, free, turn = [-1] * size, size, 0
    while free:
        while table[at[turn]] >= 0:
            at[turn] = (at[turn] + step[turn]) % size
        table[at[turn]] = turn
        free -= 1
        turn = (turn + 1) % len(shards)
    return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` plus ``slot`` (long) and ``shard`` (int); columns so named are replaced."""
    entries = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",").cast("array<int>")
    return df.withColumn("slot", slot(F.col(f"`{key}`"), size)).withColumn(
        "shard", F.get(entries, F.col("slot").cast("int")))


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, size: int = TABLE_SIZE,
                 files_per_shard: int = 8) -> None:
    """Writes one folder per shard; a shard's rows are spread over several tasks."""
    placed = place(df, key, shards, size)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)

"""Consistent sharding by a permutation-filled lookup table.

Every shard walks its own permutation of the slots of a prime-sized table; the shards take turns, each
claiming the next slot of its permutation that is still free. A key hashes to a slot, and the broadcast
table (as many rows as slots, whatever the input) turns the slot into a shard in constant time. Adding or
removing a shard moves few slots besides those it gains or loses.

Results at the edges: a null key is placed as the empty string; equal keys get equal shards; an empty input
gives an empty result; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.llm.common import literal_array, table

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """Index of the owning shard for each slot; a shard of weight k claims k slots in each of its turns."""
    if not _prime(slots):
        raise ValueError("the number of slots must be prime, so that every step walks all slots")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("one weight of 0 or more for each shard, one of them positive")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    owner, left = [-1] * slots, slots
    while left:
        for i, turns in enumerate(weights):
            for _ in range(min(turns, left)):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % slots
                owner[at[i]] = i
                left -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    """The input with its `slot` and `shard`."""
    owners = fill_table(shards, slots, weights)
    lookup = df.sparkSession.range(1).select(F.posexplode(literal_array(owners, "int")).alias("__slot", "__owner"))
    lookup = lookup.select(F.col("__slot").cast("long").alias("__slot"), F.element_at(literal_array(shards, "string"), F.col("__owner") + 1).alias("__shard"))
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*kept, slot_of(df[key], slots).alias("slot"))
    return placed.join(F.broadcast(lookup), placed["slot"] == F.col("__slot")).select(*kept, "slot", F.col("__shard").alias("shard"))


def shard_loads(placed: DataFrame) -> DataFrame:
    """Rows of each shard."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def oracle() -> str:
    owners = ",".join(SHARDS[i] for i in fill_table(SHARDS))
    return f"""
WITH owners AS (SELECT string_split('{owners}', ',') AS o),
placed AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, o[slot + 1] AS shard FROM placed, owners"""

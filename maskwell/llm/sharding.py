"""Sharding by a permutation-filled lookup table (Maglev hashing, Eisenbud et al., 2016).

Every shard orders the slots of a prime-sized table by its own permutation, and the shards
take turns claiming the first free slot of their order. A key hashes to a slot; one lookup
gives its shard. Tables of n and n + 1 shards differ in about 1 / (n + 1) of their slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table accepted; bounds what is built on the driver and broadcast.
MAX_SLOTS = 1_000_003


def _hash32(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill_table(shards: list[str], slots: int) -> list[int]:
    """Index of the owning shard for every slot.

    Raises for a size that is not prime or above ``MAX_SLOTS``, for repeated names and for
    no or more shards than slots.
    """
    if slots > MAX_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at most MAX_SLOTS")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be 1 to slots different names")
    at = [_hash32("offset:" + name) % slots for name in shards]
    skip = [_hash32("skip:" + name) % (slots - 1) + 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + skip[shard]) % slots
        owner[at[shard]] = shard
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """Rows ``slot`` long, ``shard`` string: at most ``MAX_SLOTS`` of them."""
    owner = fill_table(shards, slots)
    names = F.array(*[F.lit(name) for name in shards])
    return spark.range(slots).select(
        F.col("id").alias("slot"), F.element_at(names, F.element_at(F.lit(owner), F.col("id").cast("int") + 1) + 1).alias("shard")
    )


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key by the first 32 bits of its MD5; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots).cast("long")


def with_shard(docs: DataFrame, key_col: str, shards: list[str], slots: int = 4099) -> DataFrame:
    """``row`` (all columns of ``docs``), ``slot`` and ``shard``.

    Equal keys share a shard; null keys share the shard of the empty text. The table is
    broadcast: its size is fixed by ``slots``, never by the data, and no row is shuffled.
    """
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn(
        "slot", slot_of(F.col(f"row.{key_col}"), slots)
    )
    table = F.broadcast(lookup_table(docs.sparkSession, shards, slots))
    return keyed.join(table, "slot").select("row", "slot", "shard")


def write_shards(docs: DataFrame, path: str, key_col: str, shards: list[str], slots: int = 4099, files: int = 8) -> None:
    """Write ``docs`` as Parquet with one folder ``_shard=<name>`` per shard that has rows.

    A shard's rows are dealt to ``files`` tasks, so that a shard with a third of the rows
    still has several writers. Null keys go to the shard of the empty text, repeated rows are
    all written, an empty table gives an empty folder. A column of ``docs`` that is called
    ``_shard`` raises an error, as it would clash with the folders.
    """
    if "_shard" in docs.columns:
        raise ValueError("a column is called _shard")
    placed = with_shard(docs, key_col, shards, slots).select("row.*", F.col("shard").alias("_shard"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(files))
    placed.repartition("_shard", salt).write.partitionBy("_shard").parquet(path)

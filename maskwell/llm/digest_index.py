"""Exact duplicates by a minimal perfect hash over the digests that are known already.

The index of the known texts is a table of shards. A shard holds a minimal perfect hash of its
digests (levels of bit arrays, Limasset et al., 2017) and, slot by slot, the whole digest and
the id and number of its documents. A digest that is looked up is one only if all its bytes
equal those of its slot. Digests that no slot holds are grouped among themselves.

Digests are spread evenly over shards, whatever the texts, and copies of a text are counted
before anything is dealt to a shard. So no shard grows with a group of copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digests that a shard holds on average.
PER_SHARD = 2_048
WIDTH = 32
LEVELS = 32
INDEX = "shard int, shards int, sizes array<int>, bits array<binary>, digests binary, winners array<long>, counts array<long>"
GROUPS = "digest binary, winner long, n long, slot int"


@dataclass(frozen=True)
class PerfectHash:
    """Levels of bit arrays; a digest belongs to the first level where its bit is set.

    Its slot is the number of bits set before that bit. Digests that no level could place (in
    practice none) have the last slots, in the order of ``rest``.
    """

    levels: list[np.ndarray]
    rest: dict[bytes, int]

    @staticmethod
    def place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        """Bit of every digest at a level, from its first two 64-bit words."""
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64)
        h = words[:, 0] * odd + words[:, 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, digests: np.ndarray, levels: int = LEVELS) -> PerfectHash:
        """For rows of 32 bytes that all differ."""
        words, open_rows, made = digests.view("<u8"), np.arange(len(digests)), []
        while len(open_rows) and len(made) < levels:
            size = 2 * len(open_rows)
            at = cls.place(words[open_rows], len(made), size)
            alone = np.bincount(at, minlength=size) == 1
            made.append(alone)
            open_rows = open_rows[~alone[at]]
        start = len(digests) - len(open_rows)
        return cls(made, {digests[row].tobytes(): start + k for k, row in enumerate(open_rows)})

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of every digest; for one that is not in the set any slot, or -1."""
        words, out = digests.view("<u8"), np.full(len(digests), -1, dtype=np.int64)
        open_rows, base = np.arange(len(digests)), 0
        for k, level in enumerate(self.levels):
            at = self.place(words[open_rows], k, len(level))
            hit = level[at]
            before = np.cumsum(level) - level
            out[open_rows[hit]] = base + before[at[hit]]
            base += int(level.sum())
            open_rows = open_rows[~hit]
        for row in open_rows if self.rest else ():
            out[row] = self.rest.get(digests[row].tobytes(), -1)
        return out


def document_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digest``: SHA-256 of the whole text; a null text counts as empty."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def group_digests(slim: DataFrame) -> DataFrame:
    """``digest``, ``winner`` (largest id, null if all are), ``n``: one row per distinct text."""
    return slim.groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("n"))


def _number(digest: Column, start: int) -> Column:
    """Four bytes of a digest, from the ``start``-th on, as a number."""
    return F.conv(F.hex(F.substring(digest, start, 4)), 16, 10).cast("long")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of 32 bytes of a column of digests."""
    parts = [np.frombuffer(c.cast(pa.binary(WIDTH)).buffers()[1], np.uint8)[c.offset * WIDTH :][: len(c) * WIDTH] for c in column.chunks]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat).reshape(-1, WIDTH)


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _build(shards: int):
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        digests = _matrix(rows["digest"])
        hashed = PerfectHash.of(digests)
        order = np.argsort(hashed.slots(digests))
        taken = pa.array(order)
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int32()),
                "shards": pa.array([shards], pa.int32()),
                "sizes": _list(pa.array([len(x) for x in hashed.levels], pa.int32())),
                "bits": _list(pa.array([np.packbits(x).tobytes() for x in hashed.levels], pa.binary())),
                "digests": pa.array([digests[order].tobytes()], pa.binary()),
                "winners": _list(rows["winner"].combine_chunks().take(taken)),
                "counts": _list(rows["n"].combine_chunks().take(taken)),
            }
        )

    return build


def shards_for(n: int) -> int:
    """Shards that hold about ``PER_SHARD`` of ``n`` digests each."""
    return max(1, -(-n // PER_SHARD))


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row per shard that has digests, from the groups of :func:`group_digests`.

    ``shards`` should be :func:`shards_for` of the number of groups: a shard is built in the
    memory of one task. Without groups the index has no rows.
    """
    dealt = groups.select((_number(F.col("digest"), 5) % shards).cast("int").alias("shard"), "digest", "winner", "n")
    return dealt.groupBy("shard").applyInArrow(_build(shards), INDEX)


def _merge(blocks: int):
    def merge(key: tuple, probes: pa.Table, index: pa.Table) -> pa.Table:
        digests, block = _matrix(probes["digest"]), key[1].as_py()
        slots = np.full(len(digests), -1, dtype=np.int64)
        out = [(probes["digest"], probes["winner"], probes["n"])]
        known_slots = np.zeros(0, np.int64)
        if index.num_rows:
            row = {name: index[name][0] for name in ("sizes", "bits", "digests", "winners", "counts")}
            held = np.frombuffer(row["digests"].as_buffer(), np.uint8).reshape(-1, WIDTH)
            levels = [np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for b, n in zip(row["bits"].as_py(), row["sizes"].as_py(), strict=True)]
            start = sum(int(x.sum()) for x in levels)
            slots = PerfectHash(levels, {held[k].tobytes(): k for k in range(start, len(held))}).slots(digests)
            same = (slots >= 0) & (held[slots] == digests).all(axis=1) if len(digests) else np.zeros(0, bool)
            slots = np.where(same, slots, -1)
            # Each block answers for the slots whose digests would be looked up in it.
            known_slots = np.flatnonzero(held[:, :4].copy().view(">u4").ravel() % blocks == block)
            mine = pa.array(known_slots)
            listed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(held), [None, row["digests"].as_buffer()]).cast(pa.binary())
            out.append((listed.take(mine), row["winners"].values.take(mine), row["counts"].values.take(mine)))
        columns = [pa.chunked_array([c for part in parts for c in (part.chunks if isinstance(part, pa.ChunkedArray) else [part])]) for parts in zip(*out, strict=True)]
        slot = pa.array(np.concatenate([slots, known_slots]), mask=np.concatenate([slots, known_slots]) < 0)
        merged = pa.table([columns[0], columns[1], columns[2], slot.cast(pa.int32())], names=["digest", "winner", "n", "slot"])
        fresh = merged.filter(pa.compute.is_null(merged["slot"]))
        met = merged.filter(pa.compute.is_valid(merged["slot"]))
        sums = met.group_by("slot").aggregate([("digest", "min"), ("winner", "max"), ("n", "sum")])
        sums = sums.select(["digest_min", "winner_max", "n_sum", "slot"]).rename_columns(["digest", "winner", "n", "slot"])
        return pa.concat_tables([sums, fresh]).cast(pa.schema([("digest", pa.binary()), ("winner", pa.int64()), ("n", pa.int64()), ("slot", pa.int32())]))

    return merge


def merge_groups(groups: DataFrame, index: DataFrame, shards: int, blocks: int = 1) -> DataFrame:
    """``digest``, ``winner``, ``n``, ``slot``: all texts of the index and of ``groups`` together.

    ``slot`` is null for texts that the index does not hold. A shard's look-ups may be split
    into ``blocks``, so that a small index can meet very many new texts in bounded memory; each
    block then reads the shard's row.
    """
    first = F.col("digest")
    probes = groups.select(
        (_number(first, 5) % shards).cast("int").alias("shard"), (_number(first, 1) % blocks).cast("int").alias("block"), "digest", "winner", "n"
    )
    tables = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("shards")
    return probes.groupBy("shard", "block").cogroup(tables.groupBy("shard", "block")).applyInArrow(_merge(blocks), GROUPS)


def mark_repeats(slim: DataFrame, merged: DataFrame) -> DataFrame:
    """``id``, ``keep_id``, ``group_size``, ``kept``, ``digest`` of every row of ``slim``.

    Only groups of several rows are joined. Rows that repeat an id and a text are one document
    that stays or goes as a whole; they all count in ``group_size``. A null id is smaller than
    any other; where a group has no other all its rows stay, with a null ``keep_id``.
    """
    repeated = merged.where("n > 1").select("digest", "winner", "n", F.lit(True).alias("met"))
    joined = slim.join(repeated, "digest", "left")
    keep = F.when(F.col("met"), F.col("winner")).otherwise(F.col("id"))
    return joined.select(
        "id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), "digest"
    )


def unseen_documents(docs: DataFrame, index: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with a text that the index does not hold; of equal ones that of the largest id.

    All columns of ``docs`` and no others come back, whatever their names. Digests decide; the
    texts themselves are only read again.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    keyed = packed.select("row", F.col(f"row.{id_col}").cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(f"row.{text_col}", F.lit("")), 256)).alias("digest"))
    fresh = merge_groups(group_digests(keyed.select("id", "digest")), index, shards).where("slot IS NULL").select("digest", "winner")
    met = keyed.join(fresh, "digest").where(F.col("id").eqNullSafe(F.col("winner")))
    return met.select("row.*")


def write_index(groups: DataFrame, path: str, shards: int) -> None:
    """Store the index of ``groups`` as Parquet; see :func:`read_index`."""
    build_index(groups, shards).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """A stored index and its number of shards (1 if it is empty)."""
    index = spark.read.schema(INDEX).parquet(path)
    return index, index.agg(F.coalesce(F.max("shards"), F.lit(1))).first()[0]

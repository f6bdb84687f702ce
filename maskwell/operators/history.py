"""Tables as they were at a time: versions from a log of changes, and a join with those in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.operators.ordinal import with_ordinal

#: Time is cut into blocks of 1, 16, 16^2, ... seconds.
BASE, LEVELS = 16, 9
#: Seconds of the epoch between which blocks tell times apart; those outside share the first and the last one.
FIRST, LAST = -(BASE ** (LEVELS - 1)), 2 * BASE ** (LEVELS - 1)


def versions(changes: DataFrame, by: list[str], at: str = "at", order: str | None = None) -> DataFrame:
    """Each change with ``valid_from`` and ``valid_to``: from its time until the next change of the same key.

    ``changes`` has a boolean ``removed``, which ends a key and opens nothing; null counts as false.
    A change without a time was there before all others (``valid_from`` null); the last one of a key
    has no end (``valid_to`` null). Of several changes of a key at one time the last by ``order``
    holds. Rows with a null in ``by`` name nothing and are left out. A key with many changes is
    spread over many tasks.
    """
    named = changes.dropna(subset=by).withColumn("_at", F.col(at).cast("timestamp"))
    sort = ["_at"] if order is None else ["_at", order]
    numbered = with_ordinal(named, by, sort, "_n")
    ends = numbered.select(*by, (F.col("_n") - 1).alias("_n"), F.col("_at").alias("valid_to"), F.lit(True).alias("_ended"))
    paired = numbered.join(ends, [*by, "_n"], "left").withColumnRenamed("_at", "valid_from")
    lasts = F.col("_ended").isNull() | F.coalesce(F.col("valid_from") < F.col("valid_to"), F.col("valid_from").isNull() & F.col("valid_to").isNotNull())
    kept = paired.where(lasts & ~F.coalesce("removed", F.lit(False)))
    return kept.select(*[c for c in changes.columns if c not in ("removed", at)], "valid_from", "valid_to")


def _second(at: Column) -> Column:
    whole = F.floor(F.unix_micros(at) / 1_000_000)
    # Unlike these, the least and the greatest of values pass over nulls.
    held = F.greatest(F.lit(FIRST), F.least(whole, F.lit(LAST - 1))).cast("long")
    return F.when(at.isNotNull(), held)


def _run(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _at_level(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))


def cover(valid_from: Column, valid_to: Column) -> Column:
    """The fewest aligned blocks that cover [valid_from, valid_to): array of ``level``, ``block``, fewer than 32 a level.

    Nulls are open ends. Blocks end on seconds, so the first and last may reach beyond the interval.
    """
    start = F.coalesce(_second(valid_from), F.lit(FIRST))
    end = F.greatest(start + 1, F.coalesce(_second(valid_to) + 1, F.lit(LAST)))
    lows = [F.ceil(start / BASE**k).cast("long") for k in range(LEVELS)]
    highs = [F.floor(end / BASE**k).cast("long") for k in range(LEVELS)]
    out = []
    for k in range(LEVELS):
        blocks = _run(lows[k], highs[k] - 1)
        if k + 1 < LEVELS:
            inner, outer = lows[k + 1], highs[k + 1]
            sides = F.concat(_run(lows[k], inner * BASE - 1), _run(outer * BASE, highs[k] - 1))
            blocks = F.when(inner < outer, sides).otherwise(blocks)
        out.append(_at_level(blocks, k))
    return F.concat(*out)


def holding(valid_from: Column, valid_to: Column) -> Column:
    """Aligned blocks no shorter than [valid_from, valid_to) that hold it: array of ``level``, ``block``, two at most.

    The level is the lowest one whose blocks are as long as the interval, so an interval takes a
    16th of its blocks or more. Nulls are open ends: such intervals lie in the three longest blocks.
    """
    start = F.coalesce(_second(valid_from), F.lit(FIRST))
    last = F.greatest(start, F.coalesce(_second(valid_to), F.lit(LAST - 1)))
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(last - start < BASE**k, k).otherwise(level)
    size = F.element_at(F.array(*[F.lit(BASE**k) for k in range(LEVELS)]), level + 1)
    block = lambda second: F.floor(second / size).cast("long")
    return F.transform(F.sequence(block(start), block(last)), lambda b: F.struct(level.alias("level"), b.alias("block")))


def as_of(rows: DataFrame, kept: DataFrame, by: list[str], at: str) -> DataFrame:
    """``rows`` with the columns of every version of their key that is in force at their time ``at``.

    ``kept`` has ``by``, ``valid_from`` and ``valid_to`` (null: open), which are dropped; versions of
    a key may overlap. Rows with a null key or time, or without a version, have no result. A version
    travels once or twice, to the aligned blocks of time of its own length (see :func:`holding`), a
    row looks its time up once for each size of block that its key has. So key and block meet by
    equality: a key with many versions is spread over many tasks, and where versions follow one
    another a row meets 17 at most of each size.
    """
    blocks = kept.withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})
    blocks = blocks.withColumn("_b", F.explode(holding(F.col("valid_from"), F.col("valid_to"))))
    blocks = blocks.select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    sizes = blocks.groupBy(*by).agg(F.collect_set("_level").alias("_levels"))
    second = _second(F.col("_at"))
    block = F.element_at(F.array(*[F.floor(second / BASE**k) for k in range(LEVELS)]), F.col("_level") + 1)
    asked = rows.withColumn("_at", F.col(at).cast("timestamp")).where("_at IS NOT NULL").join(sizes, by)
    asked = asked.withColumn("_level", F.explode("_levels")).withColumn("_block", block).drop("_levels")
    met = asked.join(blocks, [*by, "_level", "_block"])
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("_at"))) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    return met.where(inside).drop("_level", "_block", "_at", "valid_from", "valid_to")

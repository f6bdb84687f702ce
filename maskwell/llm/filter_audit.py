"""How five text filters interact, for every order in which they may be applied.

Every document becomes a mask of the filters that it fails. All counts of all orders follow
from the number of documents per part and mask, at most 32 cells a part, so the documents are
read once and no order is ever run.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.shared import materialize

FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
#: Fewest words (A), least share of distinct words (B) and largest share of capitals (C), in hundredths.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text with these ``words`` fails."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        "C": 100 * capitals > MAX_CAPITALS * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(test, BIT[name]).otherwise(0) for name, test in failed.items()), F.lit(0))


def document_masks(docs: DataFrame, part: str) -> DataFrame:
    """``doc_id``, ``part``, ``digest``, ``mask`` (A to D): all that the audit needs of a document."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"],
        F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias("words"),
    )
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text"), F.col("words")).alias("mask"))


def failure_cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents per part and set of failed filters.

    A null text counts as empty and a null part as ''. E fails where a smaller id has an
    identical text anywhere in the table: a null id fails nobody and is never failed, and rows
    that repeat the smallest id do not fail each other. A document is good (toxic) if any label
    row of its id says so; a label without id marks none. An empty table has no cells.

    The smallest id of each text comes from a grouping of digests. A row passes E if it is that
    row, which is a join on digest and id together, so a text of very many copies is no hot key.
    """
    slim = materialize(document_masks(docs, part), "masks")
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(labels["quality"] == 1).alias("is_good"), F.max(labels["toxic"] == 1).alias("is_toxic")
    )
    rated = slim.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(copy, BIT["E"]).otherwise(0)
    return rated.groupBy("part", mask.alias("mask")).agg(
        F.count("*").alias("n"), F.count_if("is_good").alias("good"), F.count_if("is_toxic").alias("toxic")
    )


def _steps() -> Column:
    """Every step of every order as an array of ``filter_order``, ``step``, ``bit``, ``before``."""
    rows = []
    for order in map("".join, permutations(FILTERS)):
        for k, name in enumerate(order):
            rows.append({"filter_order": order, "step": k + 1, "bit": BIT[name], "before": sum(BIT[x] for x in order[:k])})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order string, step int, bit int, before int>>")


def audit_orders(cells: DataFrame) -> DataFrame:
    """One row per part, order and step, from the cells of :func:`failure_cells`.

    ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and
    ``shapley``. A document that fails m filters is removed by each of them in 120 / m orders.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(_steps()).alias("at")).select("part", "cells", "at.*")
    bit, before = F.col("bit"), F.col("before")

    def total(test: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(test(c["mask"]), value(c)).otherwise(0))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(bit) != 0

    def reaches(mask: Column) -> Column:
        return mask.bitwiseAND(before) == 0

    def removed(mask: Column) -> Column:
        return fails(mask) & reaches(mask)

    def count(c: Column) -> Column:
        return c["n"]

    orders = len(list(permutations(FILTERS)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: reaches(m) & ~fails(m), count).alias("kept"),
        total(removed, count).alias("removed"),
        total(lambda m: fails(m) & ~reaches(m), count).alias("redundant"),
        total(lambda m: m == bit, count).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (orders / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )

"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree domain > language > source. At each node it is shared
among the children by weight; a child can take at most its capacity (its tokens times the
epochs allowed), and what a full child leaves goes to its siblings. A node's capacity is
the sum over its leaves, so only what all siblings together cannot take reaches the level
above. Each leaf then takes whole epochs and a token-prefix of one more, in an order that
the seed, the epoch and the document id fix.

All of it is grouped aggregation and window functions over tables of leaves and of
(leaf, hash bucket); only the last part of the bucket in which a leaf's prefix ends is ordered
row by row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.shared import materialize

LEVELS = ("domain", "lang", "source")
#: 32-bit positions fall into 4096 buckets of an epoch's order, and each of those into 4096 more.
_SHIFTS = (20, 8)


def word_count(text: str = "text") -> Column:
    """Tokens of a whole text for budgeting: runs without ASCII white space; null is 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def epoch_position(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the order of an epoch, 0 to 2^32 - 1."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def _weight(key: Column, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default)).cast("long")


def share_out(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """``children`` with ``alloc``: the parent's ``budget`` shared by ``weight`` up to ``cap``.

    Sorted by capacity per weight, a child is full if the level that the budget left before
    it allows reaches its capacity; the rest share what remains in proportion, rounded down.
    A child of weight 0 gets nothing. Integer arithmetic throughout.
    """
    cap = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0)
    group = Window.partitionBy(*parent)
    before = group.orderBy("_ratio", key).rowsBetween(Window.unboundedPreceding, -1)
    frame = children.withColumns({"_cap": cap, "_ratio": ratio}).withColumns(
        {
            "_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_weight_left": F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    full = F.col("_cap").cast("decimal(19,0)") * F.col("_weight_left").cast("decimal(18,0)") <= F.col("weight").cast(
        "decimal(18,0)"
    ) * (F.col("budget") - F.col("_cap_before")).cast("decimal(19,0)")
    frame = frame.withColumn("_full", (F.col("weight") == 0) | full).withColumns(
        {
            "_left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(group), F.lit(0)),
            "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group),
        }
    )
    exact = F.expr(
        "cast(cast(weight as decimal(18,0)) * cast(greatest(_left, 0) as decimal(19,0)) as decimal(38,0)) div cast(_open as decimal(18,0))"
    )
    frame = frame.withColumn("alloc", F.when(F.col("_full"), F.col("_cap")).otherwise(exact).cast("long"))
    return frame.drop("_cap", "_ratio", "_cap_before", "_weight_left", "_full", "_left", "_open")


def _cut_buckets(placed: DataFrame, shift: int) -> DataFrame:
    """Per leaf the bucket of places in which the running sum first exceeds ``rest``, as ``cut_bucket``, and what is left of ``rest`` there.

    At most 4096 sums per leaf are added up in order.
    """
    buckets = placed.groupBy(*LEVELS, "rest", F.shiftright("place", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    summed = buckets.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")))
    first = summed.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("cut"))
    return first.select(*LEVELS, F.col("cut.bucket").alias("cut_bucket"), F.col("cut.rest").alias("rest"))


def leaf_budgets(
    leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget: int | None, max_epochs: int, default_weight: int = 1
) -> DataFrame:
    """``leaves`` (``domain``, ``lang``, ``source``, ``tokens``) with ``alloc`` tokens each.

    ``weights[level][name]`` are integers of at least 0; names not listed weigh
    ``default_weight``. ``budget`` defaults to all tokens there are.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    # A leaf below a node of weight 0 has no capacity for the levels above it.
    for level in LEVELS:
        w = _weight(F.col(level), weights.get(level, {}), default_weight)
        leaves = leaves.withColumn(f"w_{level}", w)
    dead = F.least(*[F.col(f"w_{level}") for level in LEVELS]) == 0
    leaves = leaves.withColumn("cap", F.when(dead, 0).otherwise(F.col("cap")))
    total = leaves.groupBy().agg(
        F.coalesce(F.sum("tokens") if budget is None else F.lit(budget), F.lit(0)).cast("long").alias("budget")
    )
    nodes = leaves.withColumn("root", F.lit(0)).join(F.broadcast(total.withColumn("root", F.lit(0))), "root")  # one row
    parent: list[str] = ["root"]
    for level in LEVELS:
        keys = [*parent, level]
        level_nodes = nodes.groupBy(*keys).agg(
            F.sum("cap").alias("cap"), F.first(f"w_{level}").alias("weight"), F.first("budget").alias("budget")
        )
        shared = share_out(level_nodes, parent, level).select(*keys, F.col("alloc").alias("budget"))
        nodes = nodes.drop("budget").join(shared, keys)
        parent = keys
    return nodes.select(*LEVELS, "tokens", F.col("budget").alias("alloc"))


def with_copies(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 1,
    domain: str = "domain",
    lang: str = "lang",
    source: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``domain``, ``lang``, ``source``, ``n_tokens``, ``copies``.

    ``domain``, ``lang`` and ``source`` are SQL expressions; a null is the name ''. ``copies``
    counts whole epochs and 1 more inside the last epoch's prefix; rows with 0 copies are
    returned too. Rows with equal id and token count stand at one place of the order and are
    taken together. A text without words has 0 tokens and follows its place; a leaf without
    tokens gives nothing. Columns of ``docs`` with the names used here stay inside ``row``.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.expr(domain).alias("domain"),
                       F.expr(lang).alias("lang"), F.expr(source).alias("source"),
                       F.coalesce(docs[id_col], F.lit(-(2**63))).alias("id"),
                       word_count(text_col).alias("n_tokens"))
    rows = rows.withColumns({level: F.coalesce(F.col(level).cast("string"), F.lit("")) for level in LEVELS})
    slim = materialize(rows.select(*LEVELS, "id", "n_tokens"), "mix-tokens")
    leaves = materialize(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = leaf_budgets(leaves, weights, budget, max_epochs)
    plan = materialize(
        plan.where("tokens > 0").select(
            *LEVELS, F.expr("alloc div tokens").alias("epochs"), (F.col("alloc") % F.col("tokens")).alias("rest")
        ),
        "mix-plan",
    )
    placed = slim.join(plan, list(LEVELS)).withColumn("place", epoch_position(seed, F.col("epochs"), F.col("id")))
    # Twice a bucket is cut open, so that at most a 2^24-th of a leaf is ordered row by row.
    inside = placed.select(*LEVELS, "rest", "place", "id", "n_tokens")
    for shift in _SHIFTS:
        cut = materialize(_cut_buckets(inside, shift), "mix-cut")
        inside = inside.drop("rest").join(cut, list(LEVELS)).where(F.shiftright("place", shift) == F.col("cut_bucket")).drop("cut_bucket")
    order = Window.partitionBy(*LEVELS).orderBy(F.struct("place", "id", "n_tokens"))
    last = (
        inside.withColumn("upto", F.sum("n_tokens").over(order))
        .where("upto <= rest")
        .groupBy(*LEVELS)
        .agg(F.max(F.struct("place", "id", "n_tokens")).alias("last"))
    )
    plan = materialize(plan.join(cut.drop("rest"), list(LEVELS), "left").join(last, list(LEVELS), "left"), "mix-plan")
    # One row per leaf: its size decides whether the session's threshold allows a broadcast.
    joined = rows.join(plan, list(LEVELS), "left")
    at = epoch_position(seed, F.col("epochs"), F.col("id"))
    within = (F.shiftright(at, _SHIFTS[-1]) < F.col("cut_bucket")) | (
        F.struct(at.alias("place"), F.col("id"), F.col("n_tokens")) <= F.col("last")
    )
    copies = F.coalesce(F.col("epochs"), F.lit(0)) + F.when(within, 1).otherwise(0)
    return joined.select("row", *LEVELS, "n_tokens", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], **options) -> DataFrame:
    """``docs`` as mixed: every row as many times as it has copies."""
    picked = with_copies(docs, weights, **options).where("copies > 0")
    return picked.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")

"""The entity graph as tables.

entities: ``workspace``, ``entity_id``, ``kind``, ``canonical``, ``variations`` array, ``surrogate``
edges:    ``workspace``, ``source_id``, ``relation``, ``target_id``
roles:    ``workspace``, ``person_id``, ``org_unit``, ``role``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.crypto import hmac_sha256

# Relations and the kinds that they may join (source, target).
RELATIONS = {"employer": ("person", "term"), "subsidiary_of": ("term", "term")}


def entity_id(workspace: Column, kind: Column, canonical: Column) -> Column:
    return F.sha2(F.concat_ws("|", workspace, kind, canonical), 256)


def surfaces(entities: DataFrame) -> DataFrame:
    """``workspace``, ``entity_id``, ``ord``, ``surface``: the canonical name first, then the variations."""
    listed = F.array_distinct(F.concat(F.array("canonical"), F.coalesce("variations", F.array().cast("array<string>"))))
    return entities.select("workspace", "entity_id", F.posexplode(listed).alias("ord", "surface"))


def add_new(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities with those of ``incoming`` that are not there yet by workspace, kind and name."""
    keys = ["workspace", "kind", "canonical"]
    return entities.unionByName(incoming.dropDuplicates(keys).join(entities.select(*keys), keys, "left_anti"))


def edge_problems(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """``edges`` with ``problems``: ``unknown_relation``, ``orientation_violation`` or empty.

    ``kinds`` has ``entity_id`` and ``kind``.
    """
    named = (
        edges.join(kinds.select(F.col("entity_id").alias("source_id"), F.col("kind").alias("source_kind")), "source_id", "left")
        .join(kinds.select(F.col("entity_id").alias("target_id"), F.col("kind").alias("target_kind")), "target_id", "left")
    )
    known = F.col("relation").isin(*RELATIONS)
    fits = F.lit(False)
    for relation, (source, target) in RELATIONS.items():
        fits = fits | ((F.col("relation") == relation) & (F.col("source_kind") == source) & (F.col("target_kind") == target))
    problems = F.array_compact(
        F.array(F.when(~known, "unknown_relation"), F.when(known & ~F.coalesce(fits, F.lit(False)), "orientation_violation"))
    )
    return named.withColumn("problems", problems)


def fitting_edges(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows of ``edges`` with a relation in which :func:`edge_problems` finds no problem.

    What no relation can join is left out before it meets anything. Few targets may hold most of the edges, so
    the kinds of those that occur are looked up first: where they are few, Spark sends them to the edges.
    """
    named = edges.where(F.col("relation").isin(*RELATIONS))
    sources, targets = (kinds.where(F.col("kind").isin(*{pair[at] for pair in RELATIONS.values()})) for at in (0, 1))
    sources = sources.select(F.col("entity_id").alias("source_id"), F.col("kind").alias("_source")).distinct()
    targets = targets.select(F.col("entity_id").alias("target_id"), F.col("kind").alias("_target")).distinct()
    targets = targets.join(named.select("target_id").distinct(), "target_id", "left_semi")
    met = named.join(targets, "target_id").join(sources, "source_id")
    fits = F.lit(False)
    for relation, (source, target) in RELATIONS.items():
        fits = fits | ((F.col("relation") == relation) & (F.col("_source") == source) & (F.col("_target") == target))
    return met.where(fits).select(*edges.columns)


def merge(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fold losers into winners: ``pairs`` has ``winner_id``, ``loser_id`` of one kind.

    Names of a loser become variations of its winner, after those that it has.
    """
    gone = pairs.select(F.col("loser_id").alias("entity_id"))
    names = surfaces(entities).join(pairs, F.col("entity_id") == F.col("loser_id"))
    added = names.groupBy("winner_id").agg(F.sort_array(F.collect_list(F.struct("loser_id", "ord", "surface"))).alias("more"))
    kept = entities.join(gone, "entity_id", "left_anti").join(added, F.col("entity_id") == F.col("winner_id"), "left")
    more = F.coalesce(F.col("more.surface"), F.array().cast("array<string>"))
    joined = F.array_remove(F.array_distinct(F.concat(F.coalesce("variations", F.array().cast("array<string>")), more)), F.col("canonical"))
    return kept.withColumn("variations", joined).select(*entities.columns)


def rehome(edges: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Edges or roles with loser ids replaced; repeated rows and self-loops go."""
    out = edges
    for c in columns:
        renamed = pairs.select(F.col("loser_id").alias(c), F.col("winner_id").alias("_to"))
        out = out.join(renamed, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    if len(columns) == 2:
        out = out.where(F.col(columns[0]) != F.col(columns[1]))
    return out.select(*edges.columns).distinct()


def edge_summaries(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Per entity: number of edges out, in (self-loops count as out) and of distinct dependents."""
    out = edges.groupBy(F.col("source_id").alias("entity_id")).agg(F.count("*").alias("n_out"))
    own = edges.where("source_id <> target_id").groupBy(F.col("target_id").alias("entity_id"))
    into = own.agg(F.count("*").alias("n_in"), F.countDistinct("source_id").alias("n_dependents"))
    joined = entities.select("entity_id", "surrogate").join(out, "entity_id", "left").join(into, "entity_id", "left")
    return joined.na.fill(0, ["n_out", "n_in", "n_dependents"])


def neighbours(edges: DataFrame, entity: Column) -> DataFrame:
    return edges.where((F.col("source_id") == entity) | (F.col("target_id") == entity))


def search(index: DataFrame, name: str, key: bytes) -> DataFrame:
    """Entities with a surface equal to ``name``, found by blind index: nothing is decrypted."""
    return index.where(F.col("blind_index") == hmac_sha256(F.lit(name), key))


def with_blind_index(names: DataFrame, column: str, key: bytes) -> DataFrame:
    return names.withColumn("blind_index", hmac_sha256(F.col(column), key))


def edit_conflicts(edits: DataFrame, taken: DataFrame) -> DataFrame:
    """Edits (``workspace``, ``entity_id``, ``surrogate``) that collide with a surrogate of another entity.

    ``taken`` holds the active and retired surrogates: ``workspace``, ``entity_id``, ``surrogate``, ``active``.
    An entity may be given its own active surrogate again, not one of its retired ones.
    """
    other = taken.select("workspace", "surrogate", F.col("entity_id").alias("owner"), "active")
    joined = edits.join(other, ["workspace", "surrogate"])
    clash = joined.where((F.col("owner") != F.col("entity_id")) | ~F.col("active"))
    return clash.select("workspace", "entity_id", "surrogate").distinct()


def org_path(units: DataFrame, levels: int) -> DataFrame:
    """``unit``, ``ancestor``, ``distance`` up to ``levels`` above, for units with ``unit``, ``parent``."""
    found = units.select("unit", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).where("parent is not null")
    step = found
    up = units.select(F.col("unit").alias("ancestor"), F.col("parent").alias("next")).where("parent is not null")
    for distance in range(2, levels + 1):
        step = step.join(up, "ancestor").select("unit", F.col("next").alias("ancestor"), F.lit(distance).alias("distance"))
        found = found.unionByName(step)
    return found

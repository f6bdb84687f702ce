"""Stored tables: seeding, hydrating, edges, grants, settings and checks on stored cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.crypto import decrypt, encrypt
from maskwell.operators import graph, minting
from maskwell.operators.ordinal import with_ordinal
from maskwell.shared import materialize
from maskwell.sources.files import upsert

# Fixed value: how an encrypted cell begins.
CELL_PREFIX = "bf:v1:"


def seed_pairs(entities: DataFrame, pool: DataFrame) -> DataFrame:
    """``workspace``, ``surface``, ``surrogate`` of a bundle: entities (``kind``, ``canonical``, ``variations``, ``ord``) minted by kind in order."""
    named = minting.mint_names(entities.withColumn("value", F.col("canonical")), pool, entities.select(F.col("canonical").alias("value")), ["ord"])
    listed = F.array_distinct(F.concat(F.array("canonical"), F.coalesce("variations", F.array().cast("array<string>"))))
    return named.select("workspace", F.explode(listed).alias("surface"), "surrogate")


def import_counts(rows: DataFrame) -> DataFrame:
    """``rows`` of an import with ``n_rows``, the number of rows of their kind."""
    return rows.join(rows.groupBy("kind").agg(F.count("*").alias("n_rows")), "kind")


def seed_commit(entities: DataFrame, edges: DataFrame, new_entities: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after a bundle is loaded, the same when it is loaded again.

    Entities that are there by workspace, kind and name are kept as they are; edges of unknown
    relation, wrong orientation or missing ends are left out. Both tables are written before they
    are handed on, so that a bundle loaded on top of another does not do its work again.
    """
    every = materialize(graph.add_new(entities, new_entities), "entities")
    fit = graph.fitting_edges(new_edges, every.select("entity_id", "kind"))
    return every, materialize(edges.unionByName(fit.select(*edges.columns)).distinct(), "edges")


def reidentify_cells(entities: DataFrame, key: bytes) -> DataFrame:
    """``surrogate``, ``workspace``, ``cell``: canonical names encrypted for the re-identify store."""
    return entities.select("surrogate", "workspace", encrypt(F.col("canonical"), key, F.col("workspace")).alias("cell"))


def hydrate_graph(entities: DataFrame, variations: DataFrame, edges: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """Entities with their names decrypted and collected, and edges whose ends both exist.

    ``entities``: ``workspace``, ``entity_id``, ``kind``, ``cell``, ``surrogate``; ``variations``: ``workspace``, ``entity_id``, ``ord``,
    ``cell``. One join for each table, whatever the number of entities.
    """
    entities, variations = encrypted_only(entities, "entities"), encrypted_only(variations, "variations")
    plain = variations.withColumn("name", decrypt(F.col("cell"), key, F.col("workspace")))
    per = plain.groupBy("workspace", "entity_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name")))["name"].alias("variations"))
    named = entities.withColumn("canonical", decrypt(F.col("cell"), key, F.col("workspace"))).drop("cell")
    whole = named.join(per, ["workspace", "entity_id"], "left")
    ends = entities.select("entity_id")
    kept = edges.join(ends.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi")
    kept = kept.join(ends.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    return whole.withColumn("variations", F.coalesce("variations", F.array().cast("array<string>"))), kept


def plaintext_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """``table``, ``n_rows``, ``n_plain``, ``refused``: tables whose ``cell`` is not encrypted throughout."""
    out = None
    for name, rows in tables.items():
        plain = F.coalesce(~F.col("cell").startswith(CELL_PREFIX), F.lit(False))
        one = rows.agg(F.count("*").alias("n_rows"), F.count_if(plain).alias("n_plain"))
        one = one.select(F.lit(name).alias("table"), "n_rows", "n_plain", (F.col("n_plain") > 0).alias("refused"))
        out = one if out is None else out.unionByName(one)
    return out


def encrypted_only(rows: DataFrame, name: str, cell: str = "cell") -> DataFrame:
    """``rows`` of a store; reading a cell that is not encrypted ends the job with an error. Null cells pass.

    The check is part of the rows, so nothing of such a table gets to whoever reads them.
    """
    refused = F.raise_error(F.lit(f"store {name} holds plain cells: it is refused")).cast("string")
    plain = F.coalesce(~F.col(cell).startswith(CELL_PREFIX), F.lit(False))
    return rows.withColumn(cell, F.when(plain, refused).otherwise(F.col(cell)))


def create_edges(edges: DataFrame, new: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the valid rows of ``new``, the refused rows with their ``problems``)."""
    checked = graph.edge_problems(new, kinds)
    good = checked.where("size(problems) = 0").select(*edges.columns)
    return edges.unionByName(good).distinct(), checked.where("size(problems) > 0")


def delete_edges(edges: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return edges.join(gone.select(*keys).distinct(), keys, "left_anti")


def change_grants(grants: DataFrame, granted: DataFrame, revoked: DataFrame) -> DataFrame:
    """Triples of ``identity``, ``workspace``, ``role``: a set, to which grants are added and from which revoked ones go."""
    keys = ["identity", "workspace", "role"]
    return grants.select(*keys).union(granted.select(*keys)).distinct().join(revoked.select(*keys).distinct(), keys, "left_anti")


def create_workspaces(workspaces: DataFrame, new: DataFrame) -> DataFrame:
    """``slug``, ``name``: workspaces that are there keep their name."""
    return workspaces.unionByName(new.dropDuplicates(["slug"]).join(workspaces.select("slug"), "slug", "left_anti").select(*workspaces.columns))


def write_settings(settings: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """Flags of workspaces, both replaced by the last update; a workspace of its own holds those of the whole store."""
    return upsert(settings, updates, ["workspace"], order)


def assign_roles(units: DataFrame, roles: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, roles) after ``new`` (``workspace``, ``person_id``, ``unit``, ``role``): units that are missing are made.

    ``units`` has ``workspace``, ``unit_id``, ``unit``; new ids go on from the highest.
    """
    named = new.select("workspace", "unit").distinct()
    missing = named.join(units.select("workspace", "unit"), ["workspace", "unit"], "left_anti").withColumn("_all", F.lit(0))
    top = units.agg(F.coalesce(F.max("unit_id"), F.lit(0)).alias("top"))
    fresh = with_ordinal(missing, ["_all"], ["workspace", "unit"]).join(F.broadcast(top))
    every = units.unionByName(fresh.select("workspace", (F.col("top") + F.col("ordinal") + 1).alias("unit_id"), "unit"))
    given = new.join(every, ["workspace", "unit"]).select("workspace", "person_id", "unit_id", "role")
    return every, roles.unionByName(given).distinct()


def merge_by_name(entities: DataFrame, named: DataFrame) -> DataFrame:
    """``winner_id``, ``loser_id`` of pairs named by ``workspace``, ``kind``, ``winner``, ``loser``; both must exist and differ."""
    at = entities.groupBy("workspace", "kind", "canonical").agg(F.min("entity_id").alias("id"))
    out = named
    for side in ("winner", "loser"):
        out = out.join(at.select("workspace", "kind", F.col("canonical").alias(side), F.col("id").alias(f"{side}_id")), ["workspace", "kind", side])
    return out.where("winner_id <> loser_id").select("winner_id", "loser_id")


def entity_key(kind: Column, row_id: Column) -> Column:
    return F.concat(kind, F.lit(":"), row_id.cast("string"))


def parse_entity_key(key: Column) -> Column:
    """Struct of ``kind`` and ``row_id``; null for what is no such key."""
    fits = key.rlike("^[^:]+:[0-9]+$")
    return F.when(fits, F.struct(F.substring_index(key, ":", 1).alias("kind"), F.substring_index(key, ":", -1).cast("long").alias("row_id")))

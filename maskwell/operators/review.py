"""The review loop: open items, confirmation, rejection and what is learnt.

inbox: ``item_id``, ``workspace``, ``referent``, ``entity_type``, ``value``, ``surrogate``
mapping: ``real``, ``surrogate``, ``active`` (a retired surrogate stays recognised and is never given again)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.functions.crypto import decrypt, encrypt
from maskwell.operators import candidates, dictionary, minting
from maskwell.operators.ordinal import with_ordinal

INBOX = ["item_id", "workspace", "referent", "entity_type", "value", "surrogate"]
# Fixed value: prefix of the numbered surrogates that replace retired ones.
REPLACEMENT = "BFR"


def entity_kind(entity_type: Column) -> Column:
    """Persons are persons, everything else, an unknown type too, is a term."""
    return F.when(entity_type == "person", "person").otherwise("term")


def known_values(mapping: DataFrame, inbox: DataFrame) -> DataFrame:
    """``value``: what no new surrogate may share a word with: real values, live surrogates and paired words."""
    own = inbox.select(F.col("surrogate").alias("value")).union(minting.pair_map(inbox).select("value"))
    return mapping.select(F.col("real").alias("value")).union(own).distinct()


def upsert(inbox: DataFrame, found: DataFrame, pool: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """``inbox`` with an item for each new referent of ``found`` (``workspace``, ``entity_type``, ``value``, ``order``).

    Organisations count without their legal form. Referents that are open already and values
    with the shape of a numbered surrogate give nothing. New items go on from the highest
    number, in the order of their first appearance, and get the next free names of their
    kind's pool.
    """
    real = found.where(~words.is_reserved_provisional(F.col("value")) & F.col("value").isNotNull())
    keyed = real.withColumn("referent", minting.referent_key(F.col("value"), F.col("entity_type")))
    first = keyed.groupBy("referent").agg(F.min_by(F.struct("workspace", "entity_type", "value"), F.struct(*order)).alias("f"), F.min(F.struct(*order)).alias("o"))
    fresh = first.join(inbox.select("referent"), "referent", "left_anti").select("referent", "f.*", "o.*", F.lit(0).alias("_all"))
    numbered = with_ordinal(fresh, ["_all"], [*order, "referent"]).withColumn("kind", entity_kind(F.col("entity_type")))
    named = minting.mint_names(numbered.withColumnRenamed("ordinal", "nth"), pool, known, ["nth"])
    # One number, at most: that of the last item.
    top = inbox.agg(F.coalesce(F.max("item_id"), F.lit(0)).alias("top"))
    rows = named.join(F.broadcast(top)).withColumn("item_id", F.col("top") + F.col("nth") + 1)
    return inbox.select(*INBOX).unionByName(rows.select(*INBOX))


def confirm(inbox: DataFrame, decided: DataFrame, key: bytes) -> dict[str, DataFrame]:
    """Tables after the items of ``decided`` (``item_id``) are confirmed.

    ``inbox`` loses them; ``entities`` (``workspace``, ``kind``, ``canonical``, ``variations``, ``surrogate``) and
    ``mapping`` (``real``, ``surrogate``, ``active``; one row per surface) are to be added, as are the encrypted
    ``cells`` (``surrogate``, ``workspace``, ``cell``).
    """
    items = inbox.join(decided.select("item_id").distinct(), "item_id", "left_semi")
    surfaces = minting.variations(F.col("value"), F.col("entity_type"))
    return {
        "inbox": remove(inbox, decided),
        "entities": items.select("workspace", entity_kind(F.col("entity_type")).alias("kind"), F.col("value").alias("canonical"), F.array_remove(surfaces, F.col("value")).alias("variations"), "surrogate"),
        "mapping": items.select(F.explode(surfaces).alias("real"), "surrogate", F.lit(True).alias("active")),
        "cells": items.select("surrogate", "workspace", encrypt(F.col("value"), key, F.col("workspace")).alias("cell")),
    }


def reject(inbox: DataFrame, decided: DataFrame, allowed: DataFrame) -> dict[str, DataFrame]:
    """``inbox`` without the items of ``decided`` and ``allowed`` (``word``) with their values."""
    items = inbox.join(decided.select("item_id").distinct(), "item_id", "left_semi")
    return {"inbox": remove(inbox, decided), "allowed": allowed.select("word").union(items.select("value")).distinct()}


def remove(inbox: DataFrame, decided: DataFrame) -> DataFrame:
    return inbox.join(decided.select("item_id").distinct(), "item_id", "left_anti")


def hydrate(cells: DataFrame, key: bytes, surrogates: DataFrame | None = None) -> DataFrame:
    """Stored items with ``value`` from their ``cell``; items whose value is a live surrogate or one of its words go."""
    items = cells.withColumn("value", decrypt(F.col("cell"), key, F.col("workspace"))).drop("cell")
    return items if surrogates is None else minting.purge_collisions(items, surrogates)


def hydrate_mapping(cells: DataFrame, key: bytes) -> DataFrame:
    """``real``, ``surrogate``, ``active`` from the re-identify store, all workspaces together."""
    return cells.select(decrypt(F.col("cell"), key, F.col("workspace")).alias("real"), "surrogate", F.lit(True).alias("active"))


def mine(texts: DataFrame, key: str, harmless: DataFrame, stopwords: list[str], verdict: Callable[[Column, Column], Column]) -> DataFrame:
    """Confirmed candidates of historic texts: ``value``, ``first_key``, ``first_at``, ``n``. Texts are not rewritten."""
    toks = dictionary.tokens(texts, key)
    titled = candidates.title_tokens(toks).where(~F.lower("word").isin(stopwords))
    titled = candidates.without(titled, harmless).join(texts.select(key, "text"), key)
    seen = titled.select(key, "word", "s", "e", candidates.context_of(F.col("text"), F.col("s"), F.col("e")).alias("c")).select(key, "word", "s", "e", "c.*")
    confirmed = candidates.adjudicate(seen, verdict).where("confirmed")
    per = confirmed.groupBy(F.col("word").alias("value")).agg(F.min(F.struct(key, "s")).alias("first"), F.count("*").alias("n"))
    return per.select("value", F.col(f"first.{key}").alias("first_key"), F.col("first.s").alias("first_at"), "n")


def learn(mapping: DataFrame, incoming: DataFrame, pool: list[str]) -> DataFrame:
    """``mapping`` with the pairs of ``incoming`` (``ord``, ``real``, ``surrogate``) and no surrogate that holds a real value.

    A real value that is learnt and stands anywhere in the surrogate of another retires that
    surrogate; its real value gets the next replacement: an entry of ``pool`` that holds no real
    value, then numbered ones. Surrogates are short, so they are cut into all their parts and
    joined with the real values as equal keys.
    """
    known = mapping.select("real", "surrogate", "active", F.lit(-1).cast("long").alias("ord"))
    rows = known.unionByName(incoming.select("real", "surrogate", F.lit(True).alias("active"), F.col("ord").cast("long").alias("ord")))
    live = rows.where("active")
    at = F.explode(F.sequence(F.lit(1), F.length("surrogate")))
    parts = live.select("surrogate", "real", at.alias("at")).select("surrogate", "real", F.explode(F.transform(F.sequence(F.lit(1), F.length("surrogate") - F.col("at") + 1), lambda n: F.substring("surrogate", F.col("at"), n))).alias("part"))
    reals = incoming.select(F.col("real").alias("part")).where("part <> ''").distinct()
    hit = parts.join(reals, "part").where("part <> real").select("surrogate").distinct().withColumn("_hit", F.lit(True))
    joined = rows.join(hit, "surrogate", "left").withColumn("_hit", F.col("active") & F.coalesce("_hit", F.lit(False)))
    kept = joined.select("real", "surrogate", (F.col("active") & ~F.col("_hit")).alias("active"))
    replaced = with_ordinal(joined.where("_hit").select("real", "ord", F.lit(0).alias("_all")).distinct(), ["_all"], ["ord", "real"], "ordinal")
    spark = mapping.sparkSession
    entries = spark.createDataFrame([(0, k, e) for k, e in enumerate(pool)], "kind int, position int, entry string")
    every = rows.select(F.col("real").alias("value")).distinct()
    free = minting.free_entries(entries, every).select(F.col("free").alias("ordinal"), "entry")
    size = free.agg(F.count("*").alias("n"))
    numbered = F.concat(F.lit(REPLACEMENT), F.lpad((F.col("ordinal") - F.col("n")).cast("string"), 4, "0"))
    minted = replaced.join(free, "ordinal", "left").join(F.broadcast(size)).select("real", F.coalesce("entry", numbered).alias("surrogate"), F.lit(True).alias("active"))
    return kept.unionByName(minted)


def corpus_collisions(pool: DataFrame, texts: DataFrame, stopwords: list[str], text: str = "text") -> DataFrame:
    """Entries of ``pool`` (``entry``) of which a word that is no stop-word stands in some text, in any case."""
    own = pool.select("entry", F.explode(words.words(F.lower("entry"))).alias("word")).where(~F.col("word").isin(stopwords))
    used = texts.select(F.explode(F.array_distinct(words.words(F.lower(text)))).alias("word")).join(own.select("word").distinct(), "word", "left_semi").distinct()
    return own.join(used, "word", "left_semi").select("entry").distinct()


def edit_surrogates(mapping: DataFrame, edits: DataFrame) -> DataFrame:
    """``mapping`` after ``edits`` (``real``, ``surrogate``): the old surrogate retires, the new one is active.

    An edit to a surrogate that any other value has or had, or that the value had before, is
    not applied.
    """
    taken = mapping.select("surrogate", F.col("real").alias("owner"), "active")
    clash = edits.join(taken, "surrogate").where((F.col("owner") != F.col("real")) | ~F.col("active")).select("real").distinct()
    same = edits.join(mapping.where("active"), ["real", "surrogate"], "left_semi").select("real")
    applied = edits.join(clash.union(same).distinct(), "real", "left_anti").join(mapping.select("real").distinct(), "real", "left_semi")
    flagged = mapping.join(applied.select("real", F.lit(True).alias("_edit")), "real", "left")
    old = flagged.select("real", "surrogate", (F.col("active") & F.col("_edit").isNull()).alias("active"))
    return old.unionByName(applied.select("real", "surrogate", F.lit(True).alias("active")))


def follow_merge(mapping: DataFrame, merged: DataFrame) -> DataFrame:
    """``mapping`` after a merge: surfaces of a loser map to the surrogate of its winner.

    ``merged`` has ``real`` (a surface of the loser), ``surrogate`` (that of the winner).
    """
    moved = mapping.join(merged.select("real", F.col("surrogate").alias("_to")), "real", "left")
    retired = moved.where(F.col("_to").isNotNull() & (F.col("_to") != F.col("surrogate"))).select("real", "surrogate", F.lit(False).alias("active"))
    current = moved.select("real", F.coalesce("_to", "surrogate").alias("surrogate"), (F.col("active") | F.col("_to").isNotNull()).alias("active"))
    return current.unionByName(retired).distinct()

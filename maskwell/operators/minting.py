"""Minting surrogates by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.operators.ordinal import with_ordinal
from maskwell.shared import materialize

# Fixed value: reserved phone numbers that exist.
PHONE_POOL = 100

#: Invented names by rule: first and last parts combined. Any pool can be given instead.
FIRST = ("Arno", "Berta", "Carla", "Detlef", "Edda", "Frieda", "Gero", "Hanne")
LAST = ("Ahlborn", "Brockhaus", "Conrads", "Dornbusch")
PLACES = ("Auenthal", "Birkenau", "Cranach", "Dorntal")
POOLS = {
    "person": [f"{a} {b}" for b in LAST for a in FIRST],
    "term": [f"{a} {b}" for b in PLACES for a in ("Projekt", "Vorgang", "Programm", "Initiative", "Vorhaben", "Verfahren", "Reihe", "Kreis")],
    "organization": [f"{b} {a}" for b in PLACES for a in ("Werke", "Handel", "Logistik", "Chemie", "Energie", "Optik", "Druck", "Holz")],
}
# Prefix of the numbered surrogates after a pool's end.
FALLBACK = {"person": "BFP", "term": "BFT", "organization": "BFO"}


def first_seen(found: DataFrame, key: str) -> DataFrame:
    """``kind``, ``value`` and the first place (``key``, ``s``) of each distinct value."""
    seen = found.groupBy("kind", "value").agg(F.min(F.struct(key, "s")).alias("first"))
    return seen.select("kind", "value", F.col(f"first.{key}").alias("first_key"), F.col("first.s").alias("first_at"))


def nth_free(rows: DataFrame, holes: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """``rows`` with the next free number of their kind, in the given order, counted from 0.

    ``rows`` has ``kind``, ``holes`` the numbers (``kind``, ``number``) that are taken. Row r
    gets the number before which r are free. If g numbers are free before a hole, it pushes all
    rows from the g-th on by one; so rows at r and holes at g, put in one order with holes
    first, stand at the very numbers sought. No loop, and no kind in one task.
    """
    ranked = with_ordinal(rows, ["kind"], order, "_at")
    taken = holes.select("kind", "number").distinct()
    if taken.isEmpty():
        return ranked.withColumnRenamed("_at", name)
    packed = ranked.select("kind", "_at", F.lit(True).alias("_row"), F.struct(*rows.columns).alias("_r"))
    pushed = with_ordinal(taken, ["kind"], ["number"], "_i").select("kind", (F.col("number") - F.col("_i")).alias("_at"), F.lit(False).alias("_row"))
    placed = with_ordinal(packed.unionByName(pushed, allowMissingColumns=True), ["kind"], ["_at", "_row"], name).where("_row")
    return placed.select("_r.*", name)


def reserved_number(kind: Column, value: Column) -> Column:
    """Number of the surrogate of a kind that a value equals; null if it equals none."""
    digits = F.regexp_extract(value, "([0-9]+)(@[a-z.]+)?$", 1)
    number = F.when(F.length(digits) <= 18, digits.cast("long"))
    general = F.concat(F.lit("PII-RESERVED-"), kind, F.lit("-"))
    number = F.when((kind == "phone") & value.startswith(general), number + PHONE_POOL).when(kind == "phone", number - 100).otherwise(number)
    return F.when((number >= 0) & (_surrogate(kind, number) == value), number)


def _surrogate(kind: Column, number: Column) -> Column:
    """Surrogate by number; beyond a kind's finite pool the general reserved form goes on."""
    digits = (number - PHONE_POOL).cast("string")
    general = F.concat(F.lit("PII-RESERVED-phone-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))
    return F.when((kind == "phone") & (number >= PHONE_POOL), general).otherwise(words.pii_surrogate(kind, number))


def mint_pii(found: DataFrame, key: str, known: DataFrame | None = None, issued: DataFrame | None = None, beyond: str = "raise") -> DataFrame:
    """``kind``, ``value``, ``ordinal``, ``surrogate``: numbered per kind by first appearance.

    ``issued`` are rows of earlier calls; their values keep what they have, and new numbers
    follow the last of their kind. A surrogate that equals a real value (one of ``known``, with
    column ``value``, of ``issued`` or of ``found``) is skipped and never used later. Values in
    ``found`` that have the shape of a surrogate are taken for one and not minted, unless
    ``known`` lists them as real.

    Phone numbers have a pool of ``PHONE_POOL``. At its end the job fails with an error that
    names the kind only; with ``beyond="reserved"`` numbering goes on in the reserved form that
    kinds without a name space of their own have.
    """
    if beyond not in ("raise", "reserved"):
        raise ValueError("beyond must be raise or reserved")
    spark = found.sparkSession
    real = spark.createDataFrame([], "value string") if known is None else known.select("value").where("value IS NOT NULL")
    old = spark.createDataFrame([], "kind string, value string, ordinal long, surrogate string") if issued is None else issued
    seen = first_seen(found, key)
    shaped = words.is_reserved_pii(F.col("value"))
    listed = seen.where(shaped).join(real.distinct(), "value", "left_semi").select(*seen.columns)
    fresh = seen.where(~shaped).unionByName(listed).join(old.select("kind", "value"), ["kind", "value"], "left_anti")

    taken = real.unionByName(old.select("value")).where(shaped).distinct()
    kinds = F.array(*map(F.lit, ("email", "phone", "iban", "id")))
    other = F.regexp_extract("value", "^PII-RESERVED-(.+)-[0-9]+$", 1)
    named = taken.select("value", F.explode(F.array_distinct(F.concat(kinds, F.array(other)))).alias("kind"))
    holes = named.select("kind", reserved_number(F.col("kind"), F.col("value")).alias("number")).where("number IS NOT NULL")
    if issued is None:
        numbered = nth_free(fresh, holes, ["first_key", "first_at", "value"])
        total = F.col("ordinal")
    else:
        after = old.groupBy("kind").agg((F.max("ordinal") + 1).alias("start"))
        moved = holes.join(after, "kind", "left").select("kind", (F.col("number") - F.coalesce("start", F.lit(0))).alias("number")).where("number >= 0")
        numbered = nth_free(fresh, moved, ["first_key", "first_at", "value"]).join(after, "kind", "left")
        total = F.col("ordinal") + F.coalesce("start", F.lit(0))
    rows = numbered.select("kind", "value", total.cast("long").alias("ordinal"))
    surrogate = _surrogate(F.col("kind"), F.col("ordinal"))
    if beyond == "raise":
        ended = (F.col("kind") == "phone") & (F.col("ordinal") >= PHONE_POOL)
        surrogate = F.when(ended, F.raise_error(F.concat(F.lit("no surrogate is left of the kind "), F.col("kind")))).otherwise(surrogate)
    return old.select("kind", "value", "ordinal", "surrogate").unionByName(rows.withColumn("surrogate", surrogate))


def exhausted_pools(minted: DataFrame) -> DataFrame:
    """Kinds with more values than their finite pool has surrogates; empty if minting is safe."""
    sizes = minted.groupBy("kind").agg(F.count("*").alias("n_values"))
    return sizes.where((F.col("kind") == "phone") & (F.col("n_values") > PHONE_POOL))


def pool_table(spark, pools: dict[str, list[str]]) -> DataFrame:
    """``kind``, ``position``, ``entry``: as small as the pools given."""
    rows = [(k, i, e) for k, entries in pools.items() for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "kind string, position int, entry string")


def free_entries(pool: DataFrame, known: DataFrame, value: str = "value") -> DataFrame:
    """Entries that share no word with a known value, renumbered from 0 within their kind.

    A known value may hide in an entry only as whole words, so words are joined, not substrings.
    """
    known_words = known.select(F.explode(words.words(F.lower(value))).alias("word")).distinct()
    used = pool.select("kind", "position", F.explode(words.words(F.lower("entry"))).alias("word"))
    used = used.join(known_words, "word", "left_semi").select("kind", "position").distinct()
    return with_ordinal(pool.join(used, ["kind", "position"], "left_anti"), ["kind"], ["position"], "free")


def mint_names(referents: DataFrame, pool: DataFrame, known: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """``referents`` (``kind``, ``value``) with a ``surrogate``: the n-th free entry, then numbered ones.

    Neither collides with a value of ``known``: entries that share a word with one and numbered
    surrogates that equal one are skipped.
    """
    numbered = with_ordinal(referents, ["kind"], order)
    free = free_entries(pool, known).select("kind", F.col("free").alias("ordinal"), "entry")
    sizes = free.groupBy("kind").agg(F.count("*").alias("n_free"))
    joined = materialize(numbered.join(free, ["kind", "ordinal"], "left").join(sizes, "kind", "left"), "names")
    prefix = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p)) for k, p in FALLBACK.items()], F.lit("BFK"))

    # A numbered surrogate that equals a known value is skipped.
    shaped = known.select(F.col(value).alias("v")).where(words.is_reserved_provisional(F.col("v"))).distinct()
    kinds = {p: k for k, p in FALLBACK.items()}
    kind_of = F.coalesce(*[F.when(F.substring("v", 1, 3) == p, F.lit(k)) for p, k in kinds.items()])
    number = F.when(F.length("v") <= 21, F.substring("v", F.lit(4), F.length("v")).cast("long"))
    holes = shaped.select("v", kind_of.alias("kind"), number.alias("number")).where("kind IS NOT NULL AND number IS NOT NULL")
    last = nth_free(joined.where("entry IS NULL"), holes.where(F.concat(F.substring("v", 1, 3), _four(F.col("number"))) == F.col("v")), ["ordinal"], "beyond")
    poolless = last.withColumn("surrogate", F.concat(prefix, _four(F.col("beyond"))))
    pooled = joined.where("entry IS NOT NULL").withColumn("surrogate", F.col("entry"))
    return pooled.unionByName(poolless.drop("beyond")).drop("entry", "n_free")


def _four(number: Column) -> Column:
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))


def referent_key(name: Column, entity_type: Column) -> Column:
    """Organisations with and without their legal form are one referent."""
    return F.when(entity_type == "organization", words.strip_legal_form(name)).otherwise(name)


def variations(name: Column, entity_type: Column) -> Column:
    return F.array_distinct(F.array(name, referent_key(name, entity_type)))


def inbox(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Open items: one per referent, numbered from 1 by first appearance, reserved shapes refused."""
    real = candidates.where(~words.is_reserved_provisional(F.col("value")))
    keyed = real.withColumn("referent", referent_key(F.col("value"), F.col("entity_type")))
    first = keyed.groupBy("referent", "entity_type").agg(F.min_by("value", F.struct(*order)).alias("value"), F.min(F.struct(*order)).alias("first"))
    first = first.select("referent", "entity_type", "value", *[F.col(f"first.{c}").alias(c) for c in order], F.lit(0).alias("_all"))
    numbered = with_ordinal(first, ["_all"], [*order, "referent"])
    return numbered.withColumn("item_id", F.col("ordinal") + 1).drop("ordinal", "_all")


def aligned_words(items: DataFrame, left: str, right: str, stopwords: list[str] | None = None) -> DataFrame:
    """``items`` with ``words`` of ``left`` and ``pairs`` of ``word``, ``target``: words at the same place of both names.

    Both need as many words. Stop-words, words of legal forms, words without a letter and
    words of numbered surrogates give no pair.
    """
    shared = sorted({w.lower() for form in words.LEGAL_FORMS for w in form.split()} | {w.lower() for w in stopwords or []})
    a, b = (F.split(F.trim(c), r"\s+") for c in (left, right))
    zipped = F.zip_with(a, b, lambda x, y: F.struct(x.alias("word"), y.alias("target")))
    fit = F.filter(
        zipped,
        lambda p: p["word"].rlike(r"\p{L}") & p["target"].rlike(r"\p{L}") & ~F.lower(p["word"]).isin(shared),
    )
    numbered = words.is_reserved_provisional(F.col(left)) | words.is_reserved_provisional(F.col(right))
    aligned = (F.size(a) == F.size(b)) & ~numbered
    return items.withColumns({"words": a, "pairs": F.when(aligned, fit).otherwise(F.slice(fit, 1, 0))})


def component_map(items: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """``word`` of a real name (``value``) -> ``target`` word of its ``surrogate``, where unambiguous."""
    parts = aligned_words(items, "value", "surrogate", stopwords).select(F.explode("pairs").alias("p")).select("p.word", "p.target")
    return parts.groupBy("word").agg(F.min("target").alias("target"), F.max("target").alias("last")).where("target = last").drop("last")


def pair_map(items: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """``item_id``, ``value``, ``surrogate``, ``real``: every surface of an open item and what replaces it.

    ``items`` has ``item_id``, ``value``, ``entity_type``, ``surrogate``. The name and its
    variations become the surrogate and restore to the name; each word of the name becomes
    the word of the surrogate at its place, where the whole inbox gives it one meaning.
    """
    whole = items.select("item_id", F.explode(variations(F.col("value"), F.col("entity_type"))).alias("surface"), "surrogate", F.col("value").alias("real"))
    own = items.select("item_id", F.explode(F.array_distinct(F.split(F.trim("value"), r"\s+"))).alias("word"))
    parts = own.join(component_map(items, stopwords), "word").select("item_id", F.col("word").alias("surface"), F.col("target").alias("surrogate"), F.col("word").alias("real"))
    single = parts.join(whole.select("item_id", "surface"), ["item_id", "surface"], "left_anti")
    return whole.unionByName(single.select(*whole.columns)).withColumnRenamed("surface", "value")


def purge_collisions(items: DataFrame, surrogates: DataFrame) -> DataFrame:
    """Items whose value is not a live surrogate nor one of its words."""
    parts = surrogates.select(F.explode(F.array_union(F.array("surrogate"), words.words(F.col("surrogate")))).alias("value")).distinct()
    return items.join(parts, "value", "left_anti")

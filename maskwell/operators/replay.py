"""Texts run again through the whole pass with what was known at their own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.operators import detect, dictionary, minting, overlap, scan
from maskwell.operators.history import as_of
from maskwell.operators.passes import LAYERS
from maskwell.shared import materialize


def _timed(texts: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """``_k`` (``key``, ``at``) and ``text``: places found in a text keep its time, so no join has to bring it back."""
    return texts.select(F.struct(F.col(key).alias("key"), F.col(at).alias("at")).alias("_k"), F.col(text).alias("text"))


def match_as_of(texts: DataFrame, key: str, at: str, names: DataFrame, stopwords: list[str], text: str = "text") -> DataFrame:
    """What :func:`dictionary.match` finds in each text with the names in force at the text's time ``at``.

    ``names`` has ``surface``, ``entity``, ``ord``, ``valid_from``, ``valid_to``. All windows that any
    version of the dictionary could match are looked for once, whatever the number of versions;
    those in force then decide the pass, the entity and whether a name is shared. Returns also ``at``.
    A text without a time matches nothing.
    """
    known = names.select("surface").distinct().withColumn("folded", words.fold(F.col("surface")))
    known = materialize(known, "surfaces-ever")
    longest, low, high = dictionary.extents(names)
    packed = _timed(texts, key, at, text)
    vocabulary = materialize(dictionary.vocabulary_of(packed), "vocabulary")
    if high is None:
        near = known.select(F.col("surface").alias("phrase"), "surface", F.lit(0).alias("edits")).limit(0)
    else:
        found = dictionary.near_candidates(packed, vocabulary, names, low, high)
        near = dictionary.near_names(found, known.select("surface"), stopwords)
    near = materialize(near, "near-names")

    begun = known.select("folded").unionByName(near.select(words.fold(F.col("phrase")).alias("folded")))
    spans = materialize(dictionary.begun_spans(packed, vocabulary, begun, "_k", longest), "windows-ever")
    place = ["_k", "s", "e", "phrase"]
    same = F.when(F.col("phrase") == F.col("surface"), 0).otherwise(1)
    by_fold = spans.join(known, "folded").select(*place, "surface", same.alias("rank"), F.lit(0).alias("edits"))
    by_near = spans.join(near, "phrase").select(*place, "surface", F.lit(2).alias("rank"), "edits")
    asked = by_fold.unionByName(by_near).withColumn("at", F.col("_k.at"))
    then = as_of(asked, names.select("surface", "entity", "ord", "valid_from", "valid_to"), ["surface"], "at")
    count = lambda rank: F.count_if(F.col("rank") == rank)
    best = F.min(F.struct("rank", "edits", "ord", "surface", "entity"))
    chosen = then.groupBy(*place).agg(best.alias("m"), count(0).alias("n0"), count(1).alias("n1"))
    shared = F.when(F.col("m.rank") == 0, F.col("n0") > 1).otherwise((F.col("m.rank") == 1) & (F.col("n1") > 1))
    passes = F.element_at(F.array(*map(F.lit, ("exact", "normalized", "fuzzy"))), F.col("m.rank") + 1)
    pass_name = F.when(shared, "first_name").otherwise(passes).alias("pass_name")
    return chosen.select(F.col("_k.key").alias(key), F.col("_k.at").alias("at"), "s", "e", "phrase", "m.surface", "m.entity", pass_name)


def pairs_as_of(texts: DataFrame, key: str, at: str, items: DataFrame, stopwords: list[str], text: str = "text") -> DataFrame:
    """Places of the review items open at each text's time: ``key``, ``at``, ``s``, ``e``, ``item_id``, ``surrogate``, ``real``.

    ``items`` has ``item_id``, ``value``, ``entity_type``, ``surrogate``, ``valid_from``, ``valid_to``. As in
    :func:`minting.pair_map` a single word of a name counts where all items open then give it
    one meaning. A place has the first item that claims it, the whole name before its words.
    """
    span = [F.col("valid_from"), F.col("valid_to")]
    none = F.lit(None).cast("string")
    item = F.col("item_id").cast("long").alias("item_id")
    aligned = minting.aligned_words(items, "value", "surrogate", stopwords)
    surface = F.explode(minting.variations(F.col("value"), F.col("entity_type")))
    whole = items.select(item, surface.alias("word"), "surrogate", F.col("value").alias("real"), none.alias("target"), *span)
    own = F.explode(F.array_distinct(F.split(F.trim("value"), r"\s+")))
    owned = items.select(item, own.alias("word"), none.alias("surrogate"), none.alias("real"), none.alias("target"), *span)
    meant = aligned.select(F.explode("pairs").alias("p"), *span)
    nobody = F.lit(None).cast("long").alias("item_id")
    meant = meant.select(nobody, F.col("p.word"), none.alias("surrogate"), none.alias("real"), F.col("p.target"), *span)
    surfaces = materialize(whole.unionByName(owned).unionByName(meant), "item-surfaces")

    values = surfaces.select(F.col("word").alias("value")).distinct()
    places = scan.places(_timed(texts, key, at, text), "_k", values).withColumnRenamed("value", "word")
    then = as_of(places.withColumn("at", F.col("_k.at")), surfaces, ["word"], "at")
    named = F.min(F.when(F.col("surrogate").isNotNull(), F.struct("item_id", "surrogate", "real")))
    single = F.min(F.when(F.col("surrogate").isNull(), F.col("item_id")))
    per = then.groupBy("_k", "s", "e", "word").agg(named.alias("w"), single.alias("i"), F.min("target").alias("t"), F.max("target").alias("t2"))
    by_word = F.when((F.col("t") == F.col("t2")) & F.col("i").isNotNull(), F.struct(F.col("i").alias("item_id"), F.col("t").alias("surrogate"), F.col("word").alias("real")))
    first = F.when(F.col("w").isNull() | (F.col("i") < F.col("w.item_id")), F.coalesce(by_word, "w")).otherwise(F.col("w"))
    return per.select(F.col("_k.key").alias(key), F.col("_k.at").alias("at"), "s", "e", first.alias("p")).where("p IS NOT NULL").select(key, "at", "s", "e", "p.*")


def _contacts(texts: DataFrame, key: str, at: str, contacts: DataFrame | None, known: DataFrame, kinds: list[str] | None, beyond: str, text: str) -> DataFrame:
    """Contact data with the surrogate of its text's time; what had none then is minted behind those ever issued."""
    found = detect.pii_spans(_timed(texts, key, at, text), "_k", kinds=kinds)
    found = materialize(found.select(F.col("_k.key").alias(key), F.col("_k.at").alias("at"), "kind", "value", "s", "e"), "contact-data")
    if contacts is None:
        minted = materialize(minting.mint_pii(found, key, known=known, beyond=beyond), "minted")
        return found.join(minted.select("kind", "value", "surrogate"), ["kind", "value"])
    mapped = as_of(found, contacts.select("kind", "value", "surrogate", "valid_from", "valid_to"), ["kind", "value"], "at")
    # Issued twice over time, a value has the mapping of the last number.
    issued = contacts.groupBy("kind", "value").agg(F.max_by(F.struct("ordinal", "surrogate"), "ordinal").alias("i")).select("kind", "value", "i.*")
    place = [key, "kind", "value", "s", "e"]
    fresh = materialize(found.join(mapped.select(*place), place, "left_anti").select(*found.columns), "unmapped")
    minted = materialize(minting.mint_pii(fresh, key, known=known, issued=issued, beyond=beyond), "minted")
    late = fresh.join(minted.select("kind", "value", "surrogate"), ["kind", "value"])
    return mapped.select(*found.columns, "surrogate").unionByName(late.select(*found.columns, "surrogate"))


def spans_as_of(
    texts: DataFrame,
    key: str,
    at: str,
    names: DataFrame,
    surrogates: DataFrame,
    items: DataFrame,
    stopwords: list[str],
    contacts: DataFrame | None = None,
    kinds: list[str] | None = None,
    beyond: str = "raise",
    text: str = "text",
) -> DataFrame:
    """The spans of :func:`passes.deterministic_spans`, each text by what was known at its time ``at``.

    ``key`` is unique and not null, else rows share their spans. ``names``, ``surrogates``
    (``entity``, ``surrogate``, ``canonical``), ``items`` and ``contacts`` (``kind``, ``value``,
    ``ordinal``, ``surrogate``) have ``valid_from`` and ``valid_to``, as :func:`history.versions`
    gives them. A name whose entity had no surrogate then is left standing, as it was then.
    Nothing is stored: numbers minted here for contact data unknown at its time are of this run.
    Texts are dealt to all tasks once, for all steps that read them: a small file, or one with a
    single row group, would be read by one task each time.
    """
    texts = materialize(texts.select(*dict.fromkeys((key, at, text))).repartition(key), "dealt-texts")
    columns = [key, "s", "e", "layer", "rank", "surrogate", "real"]
    level = {name: F.lit(k).alias("layer") for k, name in enumerate(LAYERS)}

    def layered(rows: DataFrame, layer: str, rank: Column, real: str) -> DataFrame:
        return rows.select(key, "s", "e", level[layer], rank.cast("long").alias("rank"), "surrogate", F.col(real).alias("real")).select(*columns)

    matched = match_as_of(texts, key, at, names, stopwords, text)
    matched = overlap.disjoint(matched.select(key, "s", "e", "at", "entity"), key)
    named = as_of(matched, surrogates.select("entity", "surrogate", "canonical", "valid_from", "valid_to"), ["entity"], "at")
    paired = pairs_as_of(texts, key, at, items, stopwords, text)
    known = names.select(F.col("surface").alias("value")).unionByName(surrogates.select(F.col("canonical").alias("value"))).unionByName(items.select("value"))
    contact = _contacts(texts, key, at, contacts, known, kinds, beyond, text)
    every = layered(named, "dictionary", F.lit(0), "canonical").unionByName(layered(paired, "pair", F.col("item_id"), "real"))
    every = every.unionByName(layered(contact, "contact", F.lit(0), "value"))
    chosen = overlap.disjoint(every, key, order=["layer", "rank"])
    return chosen.withColumn("layer", F.element_at(F.array(*map(F.lit, LAYERS)), F.col("layer") + 1)).drop("rank")


def drift(recorded: DataFrame, replayed: DataFrame, key: str) -> DataFrame:
    """``key``, ``n_same``, ``n_lost``, ``n_new``, ``n_changed``: places of spans first recorded against those of a replay.

    A place with another surrogate or layer has changed. Both tables have ``key``, ``s``, ``e``,
    ``layer``, ``surrogate``; keys without spans in either have no row.
    """
    place = [key, "s", "e"]

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*place, F.struct("layer", "surrogate").alias(name))

    met = side(recorded, "old").join(side(replayed, "new"), place, "full")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    counts = {
        "n_same": both & (F.col("old") == F.col("new")),
        "n_lost": F.col("new").isNull(),
        "n_new": F.col("old").isNull(),
        "n_changed": both & (F.col("old") != F.col("new")),
    }
    return met.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])

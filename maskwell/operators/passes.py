"""The whole pass over texts: dictionary, open review items and contact data in one splice, then novel names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.operators import candidates, detect, dictionary, minting, novel, overlap, rewrite, scan
from maskwell.shared import materialize

#: Layers by precedence: what an earlier one claims, a later one does not see.
LAYERS = ("dictionary", "pair", "contact")


def occurrences(texts: DataFrame, key: str, values: DataFrame, text: str = "text") -> DataFrame:
    """Places of each value of ``values`` as whole words, overlapping ones too: its columns with ``key``, ``s``, ``e``."""
    return scan.places(texts, key, values, text).join(values, "value")


def deterministic_spans(
    texts: DataFrame,
    key: str,
    names: DataFrame,
    surrogates: DataFrame,
    items: DataFrame,
    stopwords: list[str],
    kinds: list[str] | None = None,
    beyond: str = "raise",
) -> tuple[DataFrame, DataFrame]:
    """Disjoint spans of all three layers, and the contact data minted.

    Spans have ``key``, ``s``, ``e``, ``layer``, ``surrogate``, ``real``. ``names`` is the dictionary,
    ``surrogates`` has ``entity``, ``surrogate``, ``canonical``; ``items`` are open review items as
    for :func:`minting.pair_map`. Precedence: dictionary, then items in order of their number
    and the longer value first, then contact data; inside the dictionary and the contact data
    the longest span wins, then the leftmost. No surrogate of contact data equals a real value of
    the other layers; see :func:`minting.mint_pii` for ``beyond``.
    """
    columns = [key, "s", "e", "layer", "rank", "surrogate", "real"]
    matched = dictionary.match(texts, names, key, stopwords)
    if not names.select("entity").join(surrogates, "entity", "left_anti").isEmpty():
        # A span whose entity has no surrogate takes its place from other names, but not from other layers.
        matched = dictionary.disjoint(matched, key).join(surrogates.select("entity"), "entity", "left_semi")
    level = {name: F.lit(k).alias("layer") for k, name in enumerate(LAYERS)}
    # Else one choice settles all layers, as names come first in it. They travel by their entity.
    none = F.lit(None).cast("string")
    known = matched.select(key, "s", "e", level["dictionary"], F.lit(0).cast("long").alias("rank"), none.alias("surrogate"), none.alias("real"), "entity")
    paired = occurrences(texts, key, minting.pair_map(items, stopwords))
    paired = paired.select(key, "s", "e", level["pair"], F.col("item_id").cast("long").alias("rank"), "surrogate", "real")
    found = materialize(detect.pii_spans(texts, key, kinds=kinds), "contact-data")
    real = names.select(F.col("surface").alias("value")).unionByName(surrogates.select(F.col("canonical").alias("value")))
    real = real.unionByName(items.select("value"))
    minted = materialize(minting.mint_pii(found, key, known=real, beyond=beyond), "minted")
    contact = found.join(minted.select("kind", "value", "surrogate"), ["kind", "value"])
    contact = contact.select(key, "s", "e", level["contact"], F.lit(0).cast("long").alias("rank"), "surrogate", F.col("value").alias("real"))
    others = paired.select(*columns).unionByName(contact.select(*columns))
    every = known.unionByName(others, allowMissingColumns=True)
    chosen = overlap.disjoint(every, key, order=["layer", "rank"])
    per_entity = surrogates.groupBy("entity").agg(F.min(F.struct("surrogate", "canonical")).alias("own"))
    chosen = chosen.join(per_entity, "entity", "left")
    own = lambda mine, given: F.when(F.col("layer") == 0, F.col(f"own.{mine}")).otherwise(F.col(given)).alias(given)
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), F.col("layer") + 1).alias("layer")
    return chosen.select(key, "s", "e", layer, own("surrogate", "surrogate"), own("canonical", "real")), minted


def hop_details(chosen: DataFrame, key: str) -> DataFrame:
    """Per text: spans of each layer, distinct real values of contact data, and the surrogates put in, sorted."""
    count = lambda layer: F.count_if(F.col("layer") == layer)
    return chosen.groupBy(key).agg(
        count("dictionary").alias("n_dictionary"),
        count("pair").alias("n_pair"),
        F.count_distinct(F.when(F.col("layer") == "contact", F.col("real"))).alias("n_contact"),
        F.array_join(F.array_sort(F.collect_set("surrogate")), ",").alias("surrogates"),
    )


def session_of(chosen: DataFrame, key: str) -> DataFrame:
    """``key``, ``surrogate``, ``real``, ``seq`` of what was put into each text."""
    return chosen.select(key, "surrogate", "real", F.col("s").cast("long").alias("seq"))


def novel_names(
    blinded: DataFrame,
    key: str,
    session: DataFrame | None,
    harmless: DataFrame,
    stopwords: list[str],
    verdict: Callable[[Column, Column], Column],
    deterministic_only: bool = False,
) -> DataFrame:
    """Extents of names that no layer knows: ``key``, ``s``, ``e``, ``value``, in ``blinded`` (``key``, ``text``).

    Capitalised words, less ``stopwords``, ``harmless`` (``word``), runs that lower-case prose of
    the same text speaks against and words that owe the capital to their place, are adjudicated,
    adjacent ones grow together, and what an injected surrogate covers is cut away. Texts are
    read once, in the workers; see :mod:`novel`. Without a ``session`` the surrogates of a text are
    its own array ``values``, and no join has to bring them. With ``deterministic_only`` nothing is asked
    and nothing found.
    """
    if deterministic_only:
        return blinded.select(key, F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("value")).limit(0)
    if session is not None:
        blinded = blinded.join(scan.own_values(session, key, F.col("surrogate")), key, "left")
    asked = materialize(candidates.without(novel.unexplained(blinded, key, stopwords), harmless), "unexplained")
    judged = candidates.adjudicate(asked, verdict).where("confirmed")
    return novel.grown_names(judged, key)


def injected_ranges(blinded: DataFrame, key: str, session: DataFrame) -> DataFrame:
    """Places of each exchange's own surrogates in its blinded text, inside words and overlapping too: ``key``, ``s``, ``e``."""
    own = scan.own_values(session, key, F.col("surrogate"))
    return scan.listed_places(blinded, key, own, whole=False).select(key, "s", "e").distinct()


def clip_to_line(text: Column, s: Column, e: Column, at: Column, upto: Column) -> Column:
    """[s, e) cut at line breaks outside [at, upto): struct of ``s``, ``e``."""
    head = F.substring(text, s + 1, at - s)
    tail = F.substring(text, upto + 1, e - upto)
    start = F.when(head.contains("\n"), at - F.length(F.substring_index(head, "\n", -1))).otherwise(s)
    end = upto + F.length(F.substring_index(tail, "\n", 1))
    return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"))


def reanchor(context: Column, entity: Column, at: Column, upto: Column) -> Column:
    """First place of ``entity`` in a context that covers [at, upto): struct of ``s``, ``e``; null if there is none."""
    n = F.length(entity)
    starts = F.sequence(F.greatest(F.lit(0), upto - n), F.greatest(F.greatest(F.lit(0), upto - n), at))
    fit = F.filter(starts, lambda k: (F.substring(context, k + 1, n) == entity) & (k <= at) & (k + n >= upto))
    s = F.try_element_at(fit, F.lit(1))
    return F.when(s.isNotNull() & (n > 0), F.struct(s.cast("int").alias("s"), (s + n).cast("int").alias("e")))


def group_adjudicator(names: Column) -> Column:
    """Who confirmed a group: nobody, the only one, or the cascade of several."""
    distinct = F.array_distinct(F.array_compact(names))
    return F.when(F.size(distinct) > 1, F.lit("cascade_coalescing")).otherwise(F.try_element_at(distinct, F.lit(1)))


def blind_texts(texts: DataFrame, key: str, chosen: DataFrame, own: str | None = None) -> DataFrame:
    """``texts`` with ``n_spans`` and ``blinded`` from the spans of all layers; see :func:`rewrite.blind` for ``own``."""
    return rewrite.blind(texts, key, chosen, own)


def apply_pairs(texts: DataFrame, key: str, items: DataFrame, stopwords: list[str]) -> DataFrame:
    """``texts`` with ``blinded``: open items alone, in order of their number and the longer value first.

    For prose of tools, which no other layer reads.
    """
    found = occurrences(texts, key, minting.pair_map(items, stopwords))
    chosen = overlap.disjoint(found.select(key, "s", "e", "item_id", "surrogate"), key, order=["item_id"])
    return blind_texts(texts, key, chosen)

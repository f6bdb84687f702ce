"""License scan by diagonal voting, in DataFrame functions only.

All rolling word pairs of a text join the pairs of the template texts. A match at word w of
the text and word t of a template votes for the diagonal w - t. Votes are aggregated per
diagonal; a run of words inserted or missing moves the rest of a notice to a nearby
diagonal, so neighbouring diagonals merge into one span. A span counts if enough different
template pairs voted for it. A base phrase counts where all of its pairs lie on one
diagonal, that is where its words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.shared import materialize

# Base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Label -> short notices and well-known passages of public licence texts.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance"
    " with the license you may obtain a copy of the license",
    "apache-short": "licensed under the apache license version 2 0",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted"
    " provided that the following conditions are met",
    "cc-by": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
    " general public license as published by the free software foundation",
    "gpl-short": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
    " associated documentation files the software to deal in the software without restriction",
    "mit-short": "released under the mit license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

#: Share of a template's word pairs that a span must hold.
MIN_COVERAGE = 0.8
#: Diagonals at most this far apart merge.
MAX_DRIFT = 3


def words(text: Column) -> Column:
    """Words of a text in lower case: runs of digits, letters and characters beyond ASCII.

    Only A-Z may change for the contract. Lower-casing maps one more character into a-z, the
    Kelvin sign; it gives way to a private character first and so stays beyond ASCII.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")))
    return F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_pairs(spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """``template``, ``label``, ``base``, ``pairs``, ``t``, ``a``, ``b``, ``h``: one row per word pair.

    Its size is that of the template texts, whatever the data. A template has two words or more.
    """
    if any(len(text.split(" ")) < 2 for text in [*phrases, *templates.values()]):
        raise ValueError("a phrase or template must have two words or more")
    entries = [(p, label, True, p) for p, label in phrases.items()] + [
        (name, name, False, text) for name, text in templates.items()
    ]
    listed = F.array(*[
        F.struct(F.lit(n).alias("template"), F.lit(lab).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("body"))
        for n, lab, base, text in entries
    ])
    one = spark.range(1).select(F.explode(listed).alias("e")).select("e.*").withColumn("w", F.split("body", " "))
    pairs = one.withColumn("pairs", F.size("w") - 1).select("template", "label", "base", "pairs", "w", F.posexplode("w").alias("t", "a"))
    return pairs.where("t < pairs").select(
        "template", "label", "base", "pairs", "t", "a", F.element_at("w", F.col("t") + 2).alias("b")
    ).withColumn("h", F.xxhash64("a", "b"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] | None = None,
    templates: Mapping[str, str] | None = None,
    min_coverage: float = MIN_COVERAGE,
    max_drift: int = MAX_DRIFT,
) -> DataFrame:
    """Spans found: ``doc_id``, ``text_hash``, ``template``, ``label``, ``base``, ``first_word``, ``last_word``, ``coverage``.

    A base phrase gives a span of coverage 1 for every place. Another template gives a span
    for every run of merged diagonals that covers at least ``min_coverage`` of its pairs.
    Rows that repeat an id and a text give their spans once; null texts give none.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    rolling = texts.select(
        "doc_id", "text_hash", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 2**31 - 1).alias("b"))).alias("d", "p")
    ).select("doc_id", "text_hash", "d", F.col("p.a").alias("x"), F.col("p.b").alias("y"), F.xxhash64("p.a", "p.b").alias("h"))
    table = F.broadcast(template_pairs(spark, phrases, templates))
    hits = rolling.join(table, "h").where("x = a and y = b")
    key = ["doc_id", "text_hash", "template", "label", "base", "pairs"]
    diagonals = hits.groupBy(*key, (F.col("d") - F.col("t")).alias("diagonal")).agg(
        F.collect_set("t").alias("seen"), F.min("d").alias("lo"), F.max("d").alias("hi")
    )
    diagonals = materialize(diagonals.where(~F.col("base") | (F.size("seen") == F.col("pairs"))), "diagonals")
    one = F.lit(1.0)
    base = diagonals.where("base").select(*key[:5], F.col("lo").alias("first_word"), (F.col("hi") + 1).alias("last_word"), one.alias("coverage"))
    by_doc = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_doc) > max_drift, F.lit(True))
    # Fresh diagonals open a span; the number of those so far numbers the spans.
    runs = diagonals.where("not base").withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(by_doc))
    spans = runs.groupBy(*key, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("merged"),
        F.max(F.size("seen")).alias("single"),
        F.min("lo").alias("first_word"),
        (F.max("hi") + 1).alias("last_word"),
    )
    # A merged run must not be stretched over more than twice the template's words.
    compact = F.col("last_word") - F.col("first_word") + 1 <= 2 * (F.col("pairs") + 1)
    spans = spans.withColumn("coverage", F.when(compact, F.col("merged")).otherwise(F.col("single")) / F.col("pairs"))
    spans = spans.where(F.col("coverage") >= min_coverage)
    return base.unionByName(spans.select(*key[:5], "first_word", "last_word", "coverage"))


def label_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start, null without one. ``labels`` joins the labels of all spans,
    ``score`` is the greatest coverage, 0 without a span. Null and empty texts have no words
    and no label. Rows that repeat an id and a text all get the same result; other columns
    are not read.
    """
    spans = scan(docs, id_col, text_col, **options)
    found = materialize(
        spans.groupBy("doc_id", "text_hash").agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("first_word"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("first_word"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("coverage").alias("score"),
        ),
        "license-labels",
    )
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.size(words(F.col(text_col))).cast("long").alias("n_words")
    )
    same = rows["id"].eqNullSafe(found["doc_id"]) & (rows["hash"] == found["text_hash"])
    return rows.join(found, same, "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

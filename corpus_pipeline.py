"""Corpus preparation in five stages, each a table that the next one reads.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of ``documents``, further ones of ``docs``
included, whatever their names. Each returns an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwell.llm import bpe, langid, mixing, quality, queries, simhash
from maskwell.shared import new_path

#: Tokenisation has no SQL form.
ORACLE_SQL = None


def drop_poor_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality, by text and site, is below the threshold go.

    Null texts count as empty ones and null sources and languages as groups; repeated rows
    are rated alike.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, queries.QUALITY_THRESHOLD, host="source", path="lang")


def drop_unidentified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of undetermined language go: null texts, texts without a letter, unsure ones.

    Rows with a null language are not learnt from but judged by their text.
    """
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: five-word shingles, a similarity of 0.8 or more.

    The smallest id stays; rows that repeat an id and a text count as one, null and empty texts
    are one class, a null id stays only where its class has no other.
    """
    return simhash.keep_one_per_class(docs, words_per_shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix takes them; the budget is the tokens there are.

    A null language or source is a leaf named ''; texts without words have no tokens and
    follow their place in the order.
    """
    return mixing.mix(
        docs, queries.MIX_WEIGHTS, max_epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED, domain=queries.DOMAIN
    )


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids`` and the number of tokens of every document of the mix; null texts have none."""
    encoded = bpe.encode_documents(docs, queries.BYTE_BPE)
    return encoded.selectExpr("doc_id", "cast(size(ids) as long) AS n_tokens", "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", drop_poor_quality),
    ("language ID", drop_unidentified_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages lies a Parquet table in the shared folder.

    Repeated rows, nulls and very long texts are treated as the stages say; no row crashes a stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from every labelled row of the training side by a grouped aggregation and stay
in a table. The log-probability matrix (languages x buckets) goes to the tasks, which score
batches of whole texts with numpy, block of languages by block. Texts are read in segments,
so a very long one needs no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.shared import materialize

ORDERS = (1, 2, 3)
UNDETERMINED = "und"
_SEGMENT = 1 << 17
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; built once per worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _code_points(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letter_table()[points], points, 0).astype(np.uint32)


def _segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each code point, code points) of texts joined up to the segment size.

    Texts are parted by two non-letters and a long one is cut with the overlap that its
    longest n-gram needs, so every n-gram is seen once.
    """
    rows: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    size = 0
    edge = np.zeros(max(ORDERS) - 1, dtype=np.uint32)
    for row, text in enumerate(texts):
        points = np.concatenate((edge, _code_points(text or ""), edge))
        for at in range(0, max(1, len(points) - len(edge)), _SEGMENT):
            piece = points[at : at + _SEGMENT + len(edge)]
            rows.append(np.full(len(piece), row))
            parts.append(piece)
            size += len(piece)
            if size >= _SEGMENT:
                yield np.concatenate(rows), np.concatenate(parts)
                rows, parts, size = [], [], 0
    if parts:
        yield np.concatenate(rows), np.concatenate(parts)


def _features(rows: np.ndarray, points: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of each order that lie in one text and hold a letter.

    An n-gram counts at its last character; the zeros around a text keep the first ones.
    """
    longest = max(ORDERS)
    n = len(points) - longest + 1
    if n <= 0:
        return
    whole = rows[: n] == rows[longest - 1 :]
    for order in ORDERS:
        value = np.full(n, np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF), dtype=np.uint32)
        letters = np.zeros(n, dtype=bool)
        for k in range(longest - order, longest):
            part = points[k : k + n]
            value = (value ^ part) * np.uint32(0x85EBCA6B)
            value ^= value >> np.uint32(15)
            letters |= part != 0
        use = whole & letters
        yield rows[:n][use], (value[use] & np.uint32(buckets - 1)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob[language, bucket]`` and ``log_prior[language]``, languages in sorted order."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of each language and text, whether each text has a letter)."""
        total = np.tile(self.log_prior[:, None], (1, len(texts)))
        seen = np.zeros(len(texts), dtype=bool)
        buckets = self.log_prob.shape[1]
        for rows, points in _segments(texts):
            seen[rows[points != 0]] = True
            for row, bucket in _features(rows, points, buckets):
                for k in range(len(self.languages)):
                    total[k] += np.bincount(row, weights=self.log_prob[k][bucket], minlength=len(texts))
        return total, seen

    def best(self, texts: list[str | None]) -> pd.DataFrame:
        """``lang``, ``top``, ``rest``, ``seen`` of each text: the best language of this block (the first of equal ones), its
        log-probability, and the sum of all probabilities over that of the best."""
        total, seen = self.totals(texts)
        at = total.argmax(axis=0)
        top = total[at, np.arange(len(texts))]
        names = np.array(self.languages, dtype=object)[at]
        return pd.DataFrame({"lang": names, "top": top, "rest": np.exp(total - top).sum(axis=0), "seen": seen})


@dataclass(frozen=True)
class LanguageModels:
    """A model of any number of languages, loaded in blocks of at most ``block`` of them.

    ``counts`` is a stored table with ``lang``, ``bucket``, ``n``; ``documents`` counts the rows of each
    of ``languages``, in sorted order. The driver holds one block at a time.
    """

    counts: DataFrame
    languages: tuple[str, ...]
    documents: np.ndarray
    buckets: int
    smoothing: float
    block: int

    def __len__(self) -> int:
        return -(-len(self.languages) // self.block)

    def part(self, k: int) -> LanguageModel:
        some = self.languages[k * self.block : (k + 1) * self.block]
        of_block = self.counts.where((F.col("bucket") < self.buckets) & F.col("lang").between(some[0], some[-1]))
        table = np.zeros((len(some), self.buckets))
        at = {lang: row for row, lang in enumerate(some)}
        # One row per language of the block, with at most as many pairs as there are buckets.
        for r in of_block.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toLocalIterator():
            table[at[r.lang], r.b] = r.n
        table += self.smoothing
        prior = np.log(self.documents[k * self.block : (k + 1) * self.block]) - np.log(self.documents.sum())
        return LanguageModel(some, prior, np.log(table) - np.log(table.sum(axis=1, keepdims=True)))


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    buckets: int = 1 << 14,
    smoothing: float = 0.5,
    block: int = 256,
) -> LanguageModels:
    """Fit the model on every row of ``docs`` with a non-null language.

    A block of the model has ``block`` x ``buckets`` numbers, which bounds what the driver holds
    and a task gets at once, whatever the number of languages. A null text counts for the
    prior only. Without labelled rows the model has no language and answers ``und`` for every
    text.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}

        def drain() -> Iterator[pd.DataFrame]:
            for lang, table in tables.items():
                used = np.flatnonzero(table)
                yield pd.DataFrame({"lang": lang, "bucket": used, "n": table[used]})
            tables.clear()

        for batch in batches:
            names, code = np.unique(batch["lang"].to_numpy().astype(str), return_inverse=True)
            for name, docs_of in zip(names, np.bincount(code), strict=True):
                if len(tables) > 64 and name not in tables:
                    yield from drain()
                # The last cell counts documents.
                tables.setdefault(name, np.zeros(buckets + 1, dtype=np.int64))[-1] += docs_of
            for rows, points in _segments(batch["text"].tolist()):
                for row, bucket in _features(rows, points, buckets):
                    of = code[row]
                    for k in np.unique(of):
                        if names[k] not in tables:
                            tables[names[k]] = np.zeros(buckets + 1, dtype=np.int64)
                        tables[names[k]][:-1] += np.bincount(bucket[of == k], minlength=buckets)
        yield from drain()

    counts = labelled.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "ngram-counts")
    # The last bucket counts documents: one short row per language.
    per_lang = sorted((r.lang, r.n) for r in counts.where(F.col("bucket") == buckets).collect())
    documents = np.array([n for _, n in per_lang], dtype=float)
    return LanguageModels(counts, tuple(lang for lang, _ in per_lang), documents, buckets, smoothing, block)


def _best_of(shared: Broadcast):
    @F.pandas_udf("lang string, top double, rest double, seen boolean")
    def best(texts: pd.Series) -> pd.DataFrame:
        return shared.value.best(texts.tolist())

    return best


def with_language(docs: DataFrame, model: LanguageModels, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with ``lang_pred`` string and ``score`` double of its whole text beside it.

    A null text, or one without a letter, gives ``und`` with score 0. Equal languages go to the
    first in sorted order. Columns of ``docs`` that bear these names stay inside ``row`` and clash
    with nothing; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    if not len(model):
        return rows.select("row", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = [_best_of(spark.sparkContext.broadcast(model.part(k)))(F.col(f"row.{text_col}")) for k in range(len(model))]
    scored = rows.select("row", *[b.alias(f"b{k}") for k, b in enumerate(found)])
    blocks = [F.col(f"b{k}") for k in range(len(found))]
    top = F.greatest(*[b["top"] for b in blocks]) if len(blocks) > 1 else blocks[0]["top"]
    # The first block with the highest value names the language.
    first = F.coalesce(*[F.when(b["top"] == top, b["lang"]) for b in blocks])
    whole = reduce(Column.__add__, [b["rest"] * F.exp(b["top"] - top) for b in blocks])
    seen = blocks[0]["seen"]
    return scored.select(
        "row", F.when(seen, first).otherwise(UNDETERMINED).alias("lang_pred"), F.when(seen, 1 / whole).otherwise(0.0).alias("score")
    )


def keep_identified(
    docs: DataFrame, model: LanguageModels, languages: list[str] | None = None, min_score: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows of undetermined language or of a language not wanted.

    ``languages`` defaults to all that the model knows.
    """
    wanted = list(languages) if languages is not None else list(model.languages)
    scored = with_language(docs, model, text_col)
    return scored.where(F.col("lang_pred").isin(wanted) & (F.col("score") >= min_score)).select("row.*")

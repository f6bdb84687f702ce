"""Finding very many values in texts: each text is read once for all of them.

Texts and values first meet in the rarest word of each value, where only ids and words travel.
Each text then gets the list of values that it may hold, and one automaton (a trie with failure
links) over the values of some hundred texts runs once along each of them. A text is shuffled
once at most, however many values it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions import words
from maskwell.shared import materialize

#: Texts that share automata, and values of one automaton: both bound a task's memory.
TEXTS, VALUES = 256, 50_000


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _automata(values: list[str]) -> Iterator[ahocorasick.Automaton]:
    for start in range(0, len(values), VALUES):
        automaton = ahocorasick.Automaton()
        for value in values[start : start + VALUES]:
            automaton.add_word(value, value)
        automaton.make_automaton()
        yield automaton


def found_in(texts: list[str], lists: list[set[str]], whole: bool) -> Iterator[tuple[int, str, int, int]]:
    """(number of the text, value, start, end) of all places of each text's own values."""
    for automaton in _automata(sorted(set().union(*lists))):
        for k, (text, mine) in enumerate(zip(texts, lists, strict=True)):
            if not mine:
                continue
            for end, value in automaton.iter(text):
                if value not in mine:
                    continue
                s = end + 1 - len(value)
                if not whole or ((s == 0 or not _is_word(text[s - 1])) and (end + 1 == len(text) or not _is_word(text[end + 1]))):
                    yield k, value, s, end + 1


def _scan(whole: bool, shape: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                some = batch.slice(start, TEXTS)
                texts = some.column(1).to_pylist()
                lists = [set(x) for x in some.column(2).to_pylist()]
                row, found, at = [], [], []
                for k, value, s, _ in found_in(texts, lists, whole):
                    row.append(k)
                    found.append(value)
                    at.append(s)
                keys = some.column(0).take(pa.array(row, pa.int32()))
                ends = pa.array([s + len(v) for s, v in zip(at, found, strict=True)], pa.int32())
                yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.string()), pa.array(at, pa.int32()), ends], schema=shape.set(0, shape.field(0).with_type(keys.type)))

    return run


def listed_places(texts: DataFrame, key: str, lists: DataFrame, text: str = "text", whole: bool = True) -> DataFrame:
    """All places ``key``, ``value``, ``s``, ``e`` of each text's own values, those that overlap too.

    ``lists`` has one row per ``key`` with an array ``values``; null and empty values and null
    texts have no places. With ``whole`` no letter, digit or underscore may touch a place.
    """
    usable = F.filter("values", lambda v: v.isNotNull() & (v != ""))
    asked = lists.select(key, usable.alias("values")).where(F.size("values") > 0)
    rows = texts.select(key, F.col(text).alias("text")).where("text IS NOT NULL").join(asked, key)
    kind = rows.schema[key].dataType
    shape = T.StructType([T.StructField(key, kind), T.StructField("value", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
    arrow = pa.schema([(key, pa.null()), ("value", pa.string()), ("s", pa.int32()), ("e", pa.int32())])
    return rows.mapInArrow(_scan(whole, arrow), shape)


def possible_values(texts: DataFrame, key: str, values: DataFrame, text: str = "text") -> DataFrame:
    """``key``, ``values``: per text the known values whose rarest word it holds; texts without any are left out.

    A value without a letter, digit or underscore is found nowhere.
    """
    known = values.select("value").where("value IS NOT NULL").distinct()
    parts = known.select("value", F.explode(F.array_distinct(words.words(F.col("value")))).alias("word"))
    tokens = texts.select(key, F.explode(F.array_distinct(words.words(F.col(text)))).alias("word"))
    held = materialize(tokens.join(parts.select("word").distinct(), "word", "left_semi"), "held-words")
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    # A value with a word that no text holds has no place.
    rated = parts.join(counts, "word", "left").groupBy("value").agg(
        F.min_by("word", F.struct("n", "word")).alias("word"), F.bool_and(F.col("n").isNotNull()).alias("all")
    )
    near = held.join(rated.where("all").select("value", "word"), "word")
    return near.groupBy(key).agg(F.collect_list("value").alias("values"))


def places(texts: DataFrame, key: str, values: DataFrame, text: str = "text") -> DataFrame:
    """All places of all known values (column ``value``) in all texts as whole words: ``key``, ``value``, ``s``, ``e``."""
    return listed_places(texts, key, possible_values(texts, key, values, text), text)


def own_values(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """``key``, ``values``: the distinct values that belong to each text."""
    return rows.groupBy(key).agg(F.collect_set(value).alias("values"))

"""How far the word use of sources lies apart, from an inverted index of their terms.

For sources g and h of a language the divergence sums f(p_g, p_h) over all kept terms, where
most terms occur in neither. Every pair therefore starts at V times f of two zero counts. To
that come the terms that g alone has, by a histogram of g's counts; those that h alone has, by
h's; and what the postings of a term add where both have it. No pair meets a term that one of
the two lacks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.shared import materialize

#: Documents of a language that a term must stand in, and ranks of the term report.
MIN_DOCS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
COUNTS = "lang string, source string, term binary, n long, docs long"
#: Bytes of terms: letters, made small, and all bytes of characters beyond ASCII.
_TERM_BYTES = bytes(b if b > 0x7F else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
#: Terms that a task holds before it hands its counts on, bytes of text that are split at once, and pairs held.
HELD_TERMS, PIECE, HELD_PAIRS = 200_000, 1 << 20, 1 << 20
_GAP = re.compile(b" ")
#: Sources of a language that one task pairs with the others.
BLOCK = 64


def _pieces(blob: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a piece at a time."""
    blob, at = blob.translate(_TERM_BYTES), 0
    while at < len(blob):
        cut = len(blob)
        if at + PIECE < cut:
            gap = _GAP.search(blob, at + PIECE)
            cut = gap.start() if gap else cut
        yield blob[at:cut].split()
        at = cut


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occurrences: dict[tuple[str, str], Counter] = {}
    containing: dict[tuple[str, str], Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            terms = list(counts)
            docs = containing[lang, source]
            for at in range(0, len(terms), 10_000):
                some = terms[at : at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()),
                        pa.array([source] * len(some), pa.string()),
                        pa.array(some, pa.binary()),
                        pa.array([counts[t] for t in some], pa.int64()),
                        pa.array([docs[t] for t in some], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        occurrences.clear()
        containing.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
            counts = occurrences.setdefault((lang, source), Counter())
            docs = containing.setdefault((lang, source), Counter())
            seen: set[bytes] = set()
            for terms in _pieces(text):
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(map(len, occurrences.values())) > HELD_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term`` (UTF-8), ``n`` occurrences, ``docs`` that hold it.

    Nulls count as ''. Tasks count what they read, so a frequent word gives few rows per task.
    """
    named = docs.select(
        F.coalesce(docs["lang"], F.lit("")).alias("lang"),
        F.coalesce(docs["source"], F.lit("")).alias("source"),
        F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"),
    )
    counted = named.mapInArrow(_count_terms, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + n_terms)), exact for any count."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(SCALE)
    return _div(scaled, F.greatest(total + n_terms, F.lit(1)).cast("decimal(20,0)")) + 1


def _div(a: Column, b: Column) -> Column:
    """Whole part of a / b, without a detour over doubles."""
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so nothing overflows."""
    return _div((p - q) * (p - q), q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Sums per (lang, g, h) over the terms of a batch that both have.

    Entries k places apart that share a term are paired at once, for k = 1, 2, ... Pairs are
    summed whenever ``HELD_PAIRS`` of them are held.
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for batch in batches:
        table = pa.Table.from_batches([batch])
        for lang in table["lang"].unique().to_pylist():
            mine = table.filter(pa.compute.equal(table["lang"], lang))["entries"].combine_chunks()
            lengths = np.diff(mine.offsets.to_numpy())
            flat = mine.flatten()
            source, p, zero = (flat.field(k).to_numpy() for k in range(3))
            term = np.repeat(np.arange(len(lengths)), lengths)
            held, n_held = [], 0
            for step in range(1, int(lengths.max(initial=0))):
                left = np.flatnonzero(term[step:] == term[:-step])
                for a, b in ((left, left + step), (left + step, left)):
                    value = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
                    held.append(pd.DataFrame({"g": source[a], "h": source[b], "correction": value}))
                    n_held += len(a)
                if n_held >= HELD_PAIRS:
                    held = [pd.concat(held).groupby(["g", "h"], as_index=False)["correction"].sum()]
                    n_held = len(held[0])
                    if n_held >= HELD_PAIRS // 2:
                        yield held.pop().assign(lang=lang)
                        n_held = 0
            if held:
                yield pd.concat(held).groupby(["g", "h"], as_index=False)["correction"].sum().assign(lang=lang)


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("correction", pa.int64())])
    for frame in _corrections(batches):
        yield pa.RecordBatch.from_pandas(frame[schema.names], schema, preserve_index=False)


def audit(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` of all sources of all languages.

    Part ``pair`` has every other source of the language as item, part ``term`` the terms that
    the source uses more than its language, up to rank ``TOP_TERMS``. Null texts, languages and
    sources count as ''; a source without terms has its pairs, one that is alone in its language
    none; repeated rows count again; an empty table gives no rows; further columns are ignored.

    The pair part has a row for each two sources of a language, as asked, so its size is
    quadratic in the sources of a language but not in documents or terms. A posting list holds
    each source once. No group's terms are ever sorted in one task: only the first ``TOP_TERMS``
    of each task's share go on.
    """
    counts = materialize(term_counts(docs), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
    kept = terms.where(F.col("docs") >= MIN_DOCS).drop("docs")
    postings = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "postings")
    groups = materialize(_groups(docs, postings), "groups")

    rated = postings.join(groups.drop("histogram"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("n_terms")))
    rated = materialize(rated.withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("n_terms"))), "entries")
    return _pairs(groups, rated).unionByName(_terms(rated))


def _groups(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """A row per occurring (lang, source): number, totals, share of a zero count and histogram of shares."""
    found = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    per_count = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    summed = per_count.groupBy("lang", "source").agg(
        F.sum(F.col("n") * F.col("terms")).alias("total"), F.collect_list(F.struct("n", "terms")).alias("counted")
    )
    per_lang = postings.groupBy("lang", "term").agg(F.max("n_lang").alias("n")).groupBy("lang")
    langs = per_lang.agg(F.count("*").alias("n_terms"), F.sum("n").alias("total_lang"))
    joined = found.join(summed, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "n_terms", "total_lang"])
    total, n_terms = F.col("total"), F.col("n_terms")
    return joined.select(
        "lang",
        "source",
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number"),
        "total",
        "n_terms",
        "total_lang",
        share(F.lit(0), total, n_terms).alias("zero"),
        F.transform("counted", lambda c: F.struct(share(c["n"], total, n_terms).alias("p"), c["terms"].alias("terms"))).alias("histogram"),
    )


def _pairs(groups: DataFrame, rated: DataFrame) -> DataFrame:
    lists = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p", "zero")).alias("entries"))
    both = lists.select("lang", "entries").where(F.size("entries") > 1)
    shared = both.mapInArrow(_corrected, "lang string, g int, h int, correction long")
    shared = shared.groupBy("lang", "g", "h").agg(F.sum("correction").alias("correction"))

    # One side goes to the blocks of the other, so that no task pairs a whole language.
    last = groups.groupBy("lang").agg(F.floor(F.max("number") / BLOCK).alias("last"))
    left = groups.select(
        "lang", "source", F.floor(F.col("number") / BLOCK).alias("block"), "n_terms",
        F.col("number").alias("g"), F.col("zero").alias("zero_g"), F.col("histogram").alias("by_g"),
    )
    right = groups.join(last, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"), F.col("source").alias("item"),
        F.col("number").alias("h"), F.col("zero").alias("zero_h"), F.col("histogram").alias("by_h"),
    )
    g0, h0 = F.col("zero_g"), F.col("zero_h")
    base = gap(g0, h0)
    nothing = F.lit(0).cast("long")
    alone_g = F.aggregate(F.coalesce("by_g", F.array()), nothing, lambda s, c: s + c["terms"] * (gap(c["p"], h0) - base))
    alone_h = F.aggregate(F.coalesce("by_h", F.array()), nothing, lambda s, c: s + c["terms"] * (gap(g0, c["p"]) - base))
    met = left.join(right, ["lang", "block"]).where("g <> h")
    started = met.select("lang", "source", "item", "g", "h", (F.col("n_terms") * base + alone_g + alone_h).alias("start"))
    value = F.col("start") + F.coalesce("correction", nothing)
    summed = started.join(shared, ["lang", "g", "h"], "left").select("lang", "source", "item", value.alias("value"))
    return _ranked(summed, "pair")


def _terms(rated: DataFrame) -> DataFrame:
    more = rated.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return _ranked(more, "term").where(F.col("rank") <= TOP_TERMS)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

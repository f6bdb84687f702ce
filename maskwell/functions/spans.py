"""Span algebra inside one row. A span is a struct with ``s`` and ``e``, code points, half open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


_BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """Sum of the integers before each place of an array, in time linear in its length.

    Blocks of fixed length are summed first, and blocks of blocks, so that no array grows one
    place at a time over a whole long text.
    """
    return let(sizes, lambda x: _running(x, 3))


def _running(sizes: Column, levels: int) -> Column:
    n = F.ceil(F.size(sizes) / F.lit(_BLOCK)).cast("int")
    blocks = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def block(k: Column) -> Column:
        return F.slice(sizes, k * _BLOCK + 1, F.lit(_BLOCK))

    none = F.expr("cast(array() as array<int>)")

    def before(values: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["seen"], acc["at"]).alias("seen"))

        return F.aggregate(values, F.struct(start.cast("int").alias("at"), none.alias("seen")), step, lambda acc: acc["seen"])

    sums = F.transform(blocks, lambda k: F.aggregate(block(k), F.lit(0), lambda a, x: a + x))
    starts = before(sums, F.lit(0)) if levels == 2 else let(sums, lambda x: _running(x, levels - 1))
    return F.flatten(F.zip_with(blocks, starts, lambda k, start: before(block(k), start)))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Non-overlapping matches of a pattern: array of ``s``, ``e``, ``kind``, ``value``.

    Offsets follow from the lengths of the matches and of the gaps between them. A text
    without a match is scanned once, up to its end.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def span(pair: Column, at: Column) -> Column:
        s = (at + F.length(pair["gap"])).cast("int")
        e = (s + F.length(pair["value"])).cast("int")
        return F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("kind"), pair["value"].alias("value"))

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["value"])))
        return F.zip_with(pairs, before, span)

    # The last gap has no match behind it.
    paired = F.filter(F.zip_with(gaps, values, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value"))), lambda p: p["value"].isNotNull())
    none = F.expr("cast(array() as array<struct<s:int,e:int,kind:string,value:string>>)")
    return F.when(text.rlike(pattern), let(paired, placed)).otherwise(none)


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def splice(text: Column, spans: Column, replacement: str) -> Column:
    """Replace disjoint spans by their field ``replacement``: each piece of the text is copied once."""
    ordered = F.array_sort(spans, lambda a, b: a["s"] - b["s"])
    upto = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda x: x["e"]))
    pieces = F.zip_with(
        ordered,
        F.slice(upto, F.lit(1), F.size(ordered)),
        lambda x, at: F.concat(F.substring(text, at + 1, x["s"] - at), x[replacement]),
    )
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(upto, -1) + 1, F.length(text)))


def subtract(s: Column, e: Column, ranges: Column) -> Column:
    """Pieces of [s, e) outside all ``ranges``: array of ``s``, ``e``."""

    def piece(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("int").alias("s"), hi.cast("int").alias("e"))

    def cut(pieces: Column, r: Column) -> Column:
        return F.flatten(
            F.transform(
                pieces,
                lambda p: F.filter(
                    F.array(piece(p["s"], F.least(p["e"], r["s"])), piece(F.greatest(p["s"], r["e"]), p["e"])),
                    lambda q: q["s"] < q["e"],
                ),
            )
        )

    disjoint = F.filter(ranges, lambda r: r["s"] < r["e"])
    return F.aggregate(disjoint, F.array(piece(s, e)), cut)


def trim_edges(text: Column, s: Column, e: Column) -> Column:
    """[s, e) without white space at its edges: struct of ``s``, ``e``."""
    inner = F.substring(text, s + 1, e - s)
    lead = F.length(inner) - F.length(F.regexp_replace(inner, r"^\s+", ""))
    tail = F.length(inner) - F.length(F.regexp_replace(inner, r"\s+$", ""))
    blank = F.length(F.trim(F.regexp_replace(inner, r"\s", ""))) == 0
    return F.struct(
        F.when(blank, s).otherwise(s + lead).alias("s"), F.when(blank, s).otherwise(e - tail).alias("e")
    )

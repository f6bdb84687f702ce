"""Reports on recorded exchanges: what was replaced where, what a replay found, and what does not agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.operators.captures import annotate

#: Order of the parts of a report. Hops and what a replay found in them share a part.
BANNER, HEAD, HOPS, SUMMARY, COMPARISON = range(5)


def _text(*parts: str | Column) -> Column:
    """Parts in a row; null ones count as empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _line(rows: DataFrame, key: str, part: int, line: Column, hop: Column | None = None, at: Column | None = None, order: Column | None = None) -> DataFrame:
    return rows.select(
        key,
        F.lit(part).alias("part"),
        (F.lit(0) if hop is None else hop).cast("long").alias("hop"),
        (F.lit(-1) if at is None else at).cast("long").alias("at"),
        (F.lit("") if order is None else order).alias("ref"),
        line.alias("line"),
    )


def report_lines(
    captures: DataFrame, hops: DataFrame, injected: DataFrame, leaked: DataFrame, divergences: DataFrame, replayed: DataFrame, key: str = "capture_id"
) -> DataFrame:
    """``key``, ``part``, ``hop``, ``at``, ``ref``, ``line``: the lines of all reports, in the order of these columns.

    ``captures`` has ``endpoint``, ``outcome`` (null: in flight) and ``adjudicated``; ``hops`` has ``hop``,
    ``kind``, ``text``; ``injected`` and ``leaked`` have ``real``, ``surrogate``; ``divergences`` has
    ``surrogate``, ``severity``; ``replayed`` has ``hop``, ``pass_name``, ``s``, ``e``. A capture in flight
    gives one line. A banner comes first, and only for leaks and defects; it names surrogates or
    hashes, never a real value. Values are marked in their hops with their surrogates. A capture
    without a replayed row was not compared, which is no divergence. Repeated rows count once.
    Only the values of one capture, which is of bounded size, are gathered in one row.
    """
    ended = captures.where(F.col("outcome").isNotNull())
    here = ended.select(key)
    injected, leaked = (rows.select(key, "real", "surrogate").distinct().join(here, key, "left_semi") for rows in (injected, leaked))
    replayed = replayed.select(key, "hop", "pass_name", "s", "e").distinct().join(here, key, "left_semi")
    ran = replayed.select(key).distinct().withColumn("ran", F.lit(True))
    compared = divergences.select(key, "surrogate", "severity").distinct().join(ran, key, "left_semi")

    leaks = leaked.groupBy(key).agg(F.array_sort(F.collect_set(words.scrubbed(F.col("real"), F.col("surrogate")))).alias("leaks"))
    defects = F.collect_set(F.when(F.col("severity") == "defect", F.coalesce("surrogate", F.lit(""))))
    differ = compared.groupBy(key).agg(F.array_sort(defects).alias("defects"), F.count("*").alias("n_different"))
    pairs = injected.groupBy(key).agg(F.collect_list(F.struct("real", "surrogate")).alias("pairs"))
    known = ended.join(leaks, key, "left").join(differ, key, "left").join(ran, key, "left")
    known = known.join(pairs.select(key, F.size("pairs").alias("n_values")), key, "left")

    def banner(what: str) -> DataFrame:
        refs = F.col(what)
        line = _text("MISMATCH: ", F.size(refs), f" {what}: ", F.array_join(refs, ", "))
        return _line(known.where(F.size(refs) > 0), key, BANNER, line, order=F.lit({"leaks": "1", "defects": "2"}[what]))

    marked = hops.join(here, key, "left_semi").join(pairs, key, "left")
    found = replayed.join(hops.select(key, "hop", "text"), [key, "hop"])
    cut = F.expr("substring(text, CAST(s AS INT) + 1, CAST(e - s AS INT))")
    number = F.coalesce(F.size("leaks"), F.lit(0))
    summary = _text("summary: outcome ", F.col("outcome"), ", ", F.coalesce("n_values", F.lit(0)), " values injected, ", number, " leaks")
    unjudged = known.where(F.col("ran") & ~F.coalesce("adjudicated", F.lit(False)))
    agreed = F.when(F.col("ran"), "comparison: no divergence").otherwise("comparison: not run, there is no reconstructed section")
    parts = [
        banner("leaks"),
        banner("defects"),
        _line(captures.where(F.col("outcome").isNull()), key, HEAD, _text("capture ", F.col(key), ": in flight, no footer yet, nothing to compare")),
        _line(known, key, HEAD, _text("capture ", F.col(key), ": ", F.col("endpoint"))),
        _line(marked, key, HOPS, _text("hop ", F.col("hop"), " (", F.col("kind"), "): ", annotate(F.col("text"), F.col("pairs"))), F.col("hop")),
        _line(
            found, key, HOPS, _text("  reconstructed by ", F.col("pass_name"), " at ", F.col("s"), "-", F.col("e"), ": ", cut),
            F.col("hop"), F.col("s"), _text(F.col("e"), " ", F.col("pass_name")),
        ),
        _line(known, key, SUMMARY, summary),
        _line(unjudged, key, SUMMARY, F.lit("  note: no adjudicator took part in the replay"), order=F.lit("1")),
        _line(known.where(F.coalesce("n_different", F.lit(0)) == 0), key, COMPARISON, _text("  ", agreed)),
        _line(compared, key, COMPARISON, _text("  divergence ", F.col("severity"), ": ", F.col("surrogate")), order=_text(F.col("severity"), " ", F.col("surrogate"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def reports(lines: DataFrame, key: str = "capture_id") -> DataFrame:
    """``key``, ``report``: the lines of each capture, which is of bounded size, as one text."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "hop", "at", "ref", "line")))
    return lines.groupBy(key).agg(F.array_join(ordered["line"], "\n").alias("report"))

"""Recorded exchanges: ids, listing, replay, annotation, reports, and rows that a gate or an adjudicator leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.functions import words
from maskwell.functions.spans import let
from maskwell.operators.ordinal import with_ordinal
from maskwell.sources.files import capture_status

# Verdicts kept, and errors of a back end that mean it cannot be reached.
VERDICTS = 4096
UNREACHABLE = ("ConnectError", "ConnectTimeout", "ReadTimeout", "OSError", "HTTPStatusError", "TimeoutError")


def capture_id(ts: Column, discriminator: Column) -> Column:
    """Compact time, then four bytes of the hash of what tells captures of a second apart: sorts by time."""
    return F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.sha2(discriminator.cast("string"), 256), 1, 8))


def latest(captures: DataFrame, by: list[str]) -> DataFrame:
    """The last capture of each group: names sort by time."""
    return captures.groupBy(*by).agg(F.max("capture_id").alias("capture_id"))


def annotate(text: Column, injected: Column) -> Column:
    """Each known value followed by its surrogate: ``[real -> surrogate]``.

    ``injected`` is an array of ``real``, ``surrogate``. One scan from left to right, the longest
    value first: nothing is annotated inside what was put in, nor a value inside a longer one.
    Of several surrogates of a value the first counts; null and empty values count as absent.
    """
    usable = F.filter(F.coalesce(injected, F.array().cast("array<struct<real:string,surrogate:string>>")), lambda p: (p["real"] != "") & p["surrogate"].isNotNull())
    return F.when(F.size(usable) == 0, text).otherwise(let(usable, lambda pairs: _annotated(text, pairs)))


def _annotated(text: Column, pairs: Column) -> Column:
    reals = F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct((-F.length(p["real"])).alias("n"), p["real"].alias("real")))), lambda x: x["real"])
    pattern = F.array_join(F.transform(reals, words.quote), "|")
    gaps, found = F.split(text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0))

    def mark(real: Column) -> Column:
        surrogate = F.try_element_at(F.filter(pairs, lambda p: p["real"] == real), F.lit(1))["surrogate"]
        return F.concat(F.lit("["), real, F.lit(" -> "), surrogate, F.lit("]"))

    return F.array_join(F.zip_with(gaps, found, lambda g, r: F.concat(g, F.coalesce(mark(r), F.lit("")))), "")


def dismissals(judged: DataFrame, logged: DataFrame) -> DataFrame:
    """``word``: refused candidates, each once and only if not logged before."""
    return judged.where(~F.col("confirmed")).select("word").distinct().join(logged, "word", "left_anti")


def detection_records(chosen: DataFrame, key: str, hop: str) -> DataFrame:
    """One ``detection`` record for each hop with spans: ``key``, ``hop``, ``record``, ``section``, counts, ``surrogates``, ``offsets``."""
    per = chosen.groupBy(key, hop).agg(
        F.count_if(F.col("layer") == "contact").alias("l1_count"),
        F.count_if(F.col("layer") == "dictionary").alias("l2_count"),
        F.array_join(F.array_sort(F.collect_set("surrogate")), ",").alias("surrogates"),
        F.sort_array(F.collect_list(F.struct("s", "e"))).alias("o"),
    )
    offsets = F.array_join(F.transform("o", lambda x: F.concat_ws("-", x["s"], x["e"])), ",")
    return per.select(key, hop, F.lit("detection").alias("record"), F.lit("reconstructed").alias("section"), "l1_count", "l2_count", "surrogates", offsets.alias("offsets"))


def append_once(records: DataFrame, replayed: DataFrame, key: str) -> DataFrame:
    """Records with those of ``replayed`` of captures that have no reconstructed record yet."""
    done = records.where(F.col("section") == "reconstructed").select(key).distinct()
    return records.unionByName(replayed.join(done, key, "left_anti").select(*records.columns))


def new_capture(payloads: DataFrame, replayed: DataFrame, key: str) -> DataFrame:
    """``key``, ``line``, ``record``, ``body``: header, outbound payload, detections and footer of replayed payloads."""
    header = payloads.select(key, F.lit(0).cast("long").alias("line"), F.lit("header").alias("record"), F.lit("{}").alias("body"))
    outbound = payloads.select(key, F.lit(1).cast("long").alias("line"), F.lit("outbound").alias("record"), F.col("payload").alias("body"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("hop"))
    found = replayed.select(key, (order + 1).cast("long").alias("line"), F.lit("detection").alias("record"), F.to_json(F.struct("hop", "l1_count", "l2_count", "surrogates", "offsets")).alias("body"))
    n = replayed.groupBy(key).agg(F.count("*").alias("n"))
    footer = payloads.join(n, key, "left").select(key, (F.coalesce("n", F.lit(0)) + 2).alias("line"), F.lit("footer").alias("record"), F.lit('{"outcome":"replayed"}').alias("body"))
    return header.unionByName(outbound).unionByName(found).unionByName(footer)


def render(records: DataFrame, key: str, hop: str) -> DataFrame:
    """``key``, ``report``: a line for each hop, in order, and a last one that sums up."""
    line = F.concat(F.lit("hop "), F.col(hop), F.lit(": l1="), F.col("l1_count"), F.lit(" l2="), F.col("l2_count"), F.lit(" at "), F.col("offsets"))
    per = records.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(hop).alias("h"), line.alias("line")))).alias("l"), F.sum("l1_count").alias("a"), F.sum("l2_count").alias("b")
    )
    total = F.concat(F.lit("total: l1="), F.col("a"), F.lit(" l2="), F.col("b"))
    return per.select(key, F.array_join(F.array_append(F.col("l.line"), total), "\n").alias("report"))


def listing(lines: DataFrame) -> DataFrame:
    """``file``, ``n_records``, ``status`` and ``place`` in the order of names."""
    return with_ordinal(capture_status(lines).withColumn("_all", F.lit(0)), ["_all"], ["file"], "place").drop("_all")


def cached_verdicts(uses: DataFrame, limit: int = VERDICTS) -> DataFrame:
    """``digest``, ``last_use`` of the verdicts that a cache of ``limit`` entries holds: those used last.

    ``uses`` has ``digest`` and ``n``, the order of use. Every use renews an entry, so what is held
    after all of them are the ``limit`` digests of latest use.
    """
    last = uses.groupBy("digest").agg(F.max("n").alias("last_use"))
    return last.orderBy(F.desc("last_use"), "digest").limit(limit)


def shifted(verdict_start: Column, verdict_end: Column, at: Column, s: Column) -> Column:
    """A span kept relative to its context, moved to where the same context stands now: struct of ``s``, ``e``."""
    return F.struct((verdict_start - at + s).alias("s"), (verdict_end - at + s).alias("e"))


def adjudication_error(name: Column) -> Column:
    """``unavailable`` for a back end that cannot be reached, ``internal`` for any other error, null for none."""
    return F.when(name.isin(*UNREACHABLE), "unavailable").when(name.isNotNull(), "internal")


def block_rows(refused: DataFrame) -> dict[str, DataFrame]:
    """Rows for ``audit`` and ``blocks``, and the ``responses`` of refused requests (``exchange_id``, ``workspace``, ``event``, ``reason``, ``sub_reason``, ``ts``)."""
    error = F.to_json(F.struct(F.lit("blocked").alias("type"), F.col("sub_reason"), F.col("reason").alias("message")))
    return {
        "audit": refused.select("workspace", F.concat(F.lit("blocked-"), "event").alias("event"), "reason", F.lit(None).cast("string").alias("identity"), "ts"),
        "blocks": refused.select("sub_reason", F.col("reason").alias("scrubbed_reason"), "ts"),
        "responses": refused.select("exchange_id", F.lit(502).alias("status"), error.alias("body")),
    }


def declared_collision(real: Column, surrogate: Column) -> Column:
    """Why a value that a tool declares is left standing, without naming it."""
    return F.concat(F.lit("declared tool name collides with "), words.scrubbed(real, surrogate))


def status(dependencies: DataFrame, blocks: DataFrame, inbox: DataFrame) -> DataFrame:
    """One row: dependencies that are up or not, recent blocks and open items."""
    deps = dependencies.agg(F.count_if(F.col("state") == "ok").alias("n_ok"), F.count_if(F.col("state") != "ok").alias("n_not_ok"))
    recent = blocks.agg(F.count("*").alias("n_blocks"))
    return deps.join(F.broadcast(recent)).join(F.broadcast(inbox.agg(F.count("*").alias("n_open"))))

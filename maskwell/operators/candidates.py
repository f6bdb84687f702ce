"""Candidates for adjudication: capitalised words less all that is known to be harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.functions import words

# Fixed value: characters of context on each side of a candidate.
CONTEXT = 40
#: English and German function words; a longer list can be given to any function here.
STOPWORDS = (
    "A An And Are As At Be But By Das Dem Den Der Des Die Du Ein Eine Er Es For From He I Ich Ihr In Is It Mit Not Of On Or"
    " Sie So That The They This To Und Von Was We Wer Wie Wir With You Zu"
).split()


def title_tokens(toks: DataFrame) -> DataFrame:
    return toks.where(words.is_title(F.col("word")))


def without(candidates: DataFrame, harmless: DataFrame, column: str = "word") -> DataFrame:
    """Candidates whose word is not in a table of harmless words."""
    return candidates.join(harmless.select(F.col(column).alias("word")).distinct(), "word", "left_anti")


def declared_tools(tools: DataFrame, name: str) -> DataFrame:
    """Names of tools and their parts between ``_``, ``.`` and ``-``: ``word``."""
    parts = F.array_union(F.array(F.col(name)), F.split(F.col(name), r"[_.\-]+"))
    return tools.select(F.explode(parts).alias("word")).where("word <> ''").distinct()


def system_confined(toks: DataFrame, key: str, is_system: Column) -> DataFrame:
    """(``key``, ``word``) for capitalised words that stand in system parts only."""
    marked = title_tokens(toks).groupBy(key, "word").agg(F.bool_and(is_system).alias("only"))
    return marked.where("only").select(key, "word")


def phrase_ranges(toks: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """Ranges of two-word phrases in any case, parted by white space: ``key``, ``s``, ``e``."""
    order = Window.partitionBy(key).orderBy("n")
    pairs = toks.select(
        key, "s", F.lower("word").alias("a"), F.lower(F.lead("word").over(order)).alias("b"),
        F.lead("gap").over(order).alias("between"), F.lead("e").over(order).alias("e"),
    ).where(F.col("between").rlike(r"^\s+$"))
    named = phrases.select(F.split(F.lower(F.trim("phrase")), r"\s+").alias("p")).where(F.size("p") == 2)
    named = named.select(F.element_at("p", 1).alias("a"), F.element_at("p", 2).alias("b")).distinct()
    return pairs.join(named, ["a", "b"]).select(key, "s", "e")


def outside_ranges(spans_of: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Spans that lie in no range of the same text."""
    r = ranges.select(F.col(key).alias("_k"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    inside = (F.col(key) == F.col("_k")) & (F.col("s") >= F.col("_s")) & (F.col("e") <= F.col("_e"))
    return spans_of.join(r, inside, "left_anti")


#: What a lower-case word in it says nothing about prose: addresses, links, dotted or hyphenated names.
NOT_PROSE = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)+|[\p{L}\p{N}_]+://\S+|[\p{L}\p{N}_]+(?:[.\-][\p{L}\p{N}_]+)+"


def prose(text: Column) -> Column:
    """A text in which links, addresses and dotted or hyphenated names are blank."""
    return F.regexp_replace(text, NOT_PROSE, " ")


def case_evidence(toks: DataFrame, scope: str, in_prose: DataFrame | None = None) -> DataFrame:
    """Per ``scope`` and folded word: how often it stands in lower case and capitalised.

    Lower-case words count in ``in_prose`` if that is given (``scope``, ``word``; see
    :func:`prose`), else in ``toks``; capitalised ones always in ``toks``.
    """
    low, folded = F.col("word").rlike(r"^\p{Ll}+$"), F.replace(F.lower("word"), F.lit("ß"), F.lit("ss")).alias("folded")
    lower = (toks if in_prose is None else in_prose).where(low).select(scope, folded, F.lit(1).alias("low"), F.lit(0).alias("title"))
    title = title_tokens(toks).select(scope, folded, F.lit(0).alias("low"), F.lit(1).alias("title"))
    counted = lower.unionByName(title).groupBy(scope, "folded")
    return counted.agg(F.sum("low").alias("n_lower"), F.sum("title").alias("n_title"))


def case_runs(toks: DataFrame, key: str, evidence: DataFrame, proportionate: bool = True) -> DataFrame:
    """Runs of adjacent capitalised words and whether every word of the run has evidence.

    ``evidence`` has ``key``, ``folded``, ``n_lower``, ``n_title``. Words belong to one run if
    only blanks or tabs part them.
    """
    order = Window.partitionBy(key).orderBy("n")
    titled = toks.withColumn("before", F.lag("word").over(order)).where(words.is_title(F.col("word")))
    follows = F.coalesce(words.is_title(F.col("before")) & F.col("gap").rlike(r"^[ \t]+$"), F.lit(False))
    runs = titled.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(order))
    runs = runs.withColumn("folded", F.replace(F.lower("word"), F.lit("ß"), F.lit("ss"))).join(evidence, [key, "folded"], "left")
    has = F.coalesce(F.col("n_lower") > (F.col("n_title") if proportionate else F.lit(0)), F.lit(False))
    return runs.groupBy(key, "run").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n_words"), F.bool_and(has).alias("suppressed")
    )


#: Signs that may stand between the start of a line and its first word, and those that open an item of a list.
LINE_SIGNS = " \t#>*+-_"
ITEM_SIGNS = "*+-"
OPENERS = "\"'‘“"
CLOSERS = "\"'’”)]"


def _without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def word_position(gap: Column, first: Column, before: Column, gap_before: Column) -> tuple[Column, Column]:
    """Whether a word opens a line, sentence or quotation, and whether it opens an item of a list.

    ``gap`` is what parts the word from the one before, ``first`` whether it is the text's first
    word, ``before`` and ``gap_before`` are the same of the word before: the number of a list
    item is a word itself.
    """
    blank = F.lit("")
    lead = F.substring_index(gap, "\n", -1)
    fresh_line = first | gap.contains("\n")
    opens_line = fresh_line & (_without(_without(lead, LINE_SIGNS), OPENERS) == blank)
    bullet = fresh_line & (F.length(_without(lead, ITEM_SIGNS)) < F.length(lead)) & (_without(lead, " \t" + ITEM_SIGNS + "_") == blank)
    own_line = (F.col("n") == 1) | gap_before.contains("\n")
    numbered = F.coalesce(before.rlike("^[0-9]+$") & own_line, F.lit(False))
    numbered &= (_without(F.substring_index(gap_before, "\n", -1), " \t") == blank) & F.substring(gap, 1, 1).isin(".", ")")
    numbered &= _without(F.substring(gap, 2, 2**30), " \t*_") == blank
    numbered = F.coalesce(numbered, F.lit(False))
    unquoted = F.rtrim(gap, F.lit(OPENERS))
    spaced = F.length(F.regexp_replace(unquoted, r"\s+$", "")) < F.length(unquoted)
    ending = F.rtrim(F.regexp_replace(unquoted, r"\s+$", ""), F.lit(CLOSERS))
    opens_sentence = spaced & F.substring(ending, -1, 1).isin(".", "!", "?")
    quoted = F.length(unquoted) < F.length(gap)
    return opens_line | bullet | numbered | opens_sentence | quoted, bullet | numbered


def positional_noise(toks: DataFrame, key: str) -> DataFrame:
    """(``key``, ``word``) of capitalised words that owe the capital to their position.

    Every capitalised occurrence is at the start of a line, sentence or quotation, and the
    word also stands in lower case or one occurrence opens a list item. The gap before a word
    tells its position, so no text is cut at every word.
    """
    order = Window.partitionBy(key).orderBy("n")
    counted = toks.withColumns({"before": F.lag("word").over(order), "gap_before": F.lag("gap").over(order)})
    starts, listed = word_position(F.col("gap"), F.col("n") == 0, F.col("before"), F.col("gap_before"))
    placed = title_tokens(counted).groupBy(key, "word").agg(F.bool_and(starts).alias("starts"), F.bool_or(listed).alias("listed"))
    lower = toks.select(key, F.col("word").alias("low")).distinct()
    noted = placed.where("starts").withColumn("low", F.lower("word")).join(lower.withColumn("in_lower", F.lit(True)), [key, "low"], "left")
    return noted.where("listed or in_lower").select(key, "word")


def context_of(text: Column, s: Column, e: Column) -> Column:
    """Struct of ``context`` (40 characters on each side) and ``at``, the span's start in it."""
    left = F.greatest(F.lit(0), s - CONTEXT)
    return F.struct(F.substring(text, left + 1, e + CONTEXT - left).alias("context"), (s - left).alias("at"))


def digest(word: Column, context: Column, at: Column) -> Column:
    """Key of a verdict: the parts with their lengths, so that no two triples agree by chance."""
    parts = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (word, context, at.cast("string"))]
    return F.sha2(F.concat(*parts), 256)


def adjudicate(candidates: DataFrame, verdict: Callable[[Column, Column], Column]) -> DataFrame:
    """Verdict of each distinct candidate, asked once and joined back by digest.

    ``verdict(word, context)`` is an expression or a pandas UDF; it must depend on nothing else.
    """
    keyed = candidates.withColumn("digest", digest(F.col("word"), F.col("context"), F.col("at")))
    asked = keyed.groupBy("digest").agg(F.first("word").alias("w"), F.first("context").alias("c"))
    answers = asked.select("digest", verdict(F.col("w"), F.col("c")).alias("confirmed"))
    return keyed.join(answers, "digest")


def cascade(first: Callable[[Column, Column], Column], second: Callable[[Column, Column], Column]):
    """A cheap adjudicator whose refusals go to a costly one."""
    return lambda word, context: F.when(first(word, context), F.lit(True)).otherwise(second(word, context))


def coalesce_extents(extents: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Merge extents that overlap or are parted by blanks only: ``key``, ``s``, ``e``, ``entity_type``, ``n``."""
    order = Window.partitionBy(key).orderBy("s", "e")
    upto = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = extents.join(texts.select(key, text), key).withColumn("upto", upto)
    gap = F.substring(F.col(text), F.col("upto") + 1, F.greatest(F.lit(0), F.col("s") - F.col("upto")))
    same = F.coalesce((F.col("s") <= F.col("upto")) | gap.rlike(r"^[ \t]+$"), F.lit(False))
    runs = rows.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order))
    return runs.groupBy(key, "run").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("entity_type", F.when(F.col("entity_type").isNotNull(), F.col("s"))).alias("entity_type"),
        F.count("*").alias("n"),
    ).drop("run")

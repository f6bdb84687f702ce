"""Queries on reports of exchanges and on files that a store is seeded from.

Conversations stand for exchanges, capitalised words of six letters or more for the values injected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.operators import candidates, dictionary, explain, records
from maskwell.plans import language
from maskwell.plans.pii import table
from maskwell.plans.records import ENTITIES, entities
from maskwell.shared import materialize, new_path
from maskwell.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return register


# Every seventh exchange is in flight, every fifth was not replayed. Words of nine letters leaked; a replay finds
# words of an even number of letters; those of the benchmark are in the graph.
REPORT_SQL = f"""{language.HOPS_SQL}, {language.TOKENS_SQL},
titled AS (SELECT conv_id, turn, s, e, word FROM toks JOIN hops USING (hop) WHERE regexp_matches(word, '{words.TITLE}') AND length(word) >= 6 AND conv_id % 7 <> 0),
vals AS (SELECT DISTINCT conv_id, word FROM titled),
again AS (SELECT * FROM titled WHERE conv_id % 5 <> 0 AND length(word) % 2 = 0), ran AS (SELECT DISTINCT conv_id FROM again),
graph AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{words.WORD}')) AS word FROM benchmark),
differ AS (SELECT conv_id, word, CASE WHEN word IN (SELECT word FROM graph) THEN 'defect' ELSE 'expected' END AS severity
  FROM vals WHERE conv_id IN (SELECT conv_id FROM ran) AND length(word) % 2 = 1),
every AS (SELECT DISTINCT conv_id FROM conversations), done AS (SELECT conv_id FROM every WHERE conv_id % 7 <> 0),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (length(word) = 9) AS leaks,
  string_agg('S-' || lower(word), ', ' ORDER BY 'S-' || lower(word)) FILTER (length(word) = 9) AS refs FROM vals GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n, count(*) FILTER (severity = 'defect') AS bad,
  string_agg('S-' || lower(word), ', ' ORDER BY 'S-' || lower(word)) FILTER (severity = 'defect') AS refs FROM differ GROUP BY conv_id),
pats AS (SELECT conv_id, '(' || string_agg(word, '|' ORDER BY length(word) DESC, word) || ')' AS pat FROM vals GROUP BY conv_id),
marked AS (SELECT conv_id, turn, role, CASE WHEN pat IS NULL THEN [text] ELSE string_split_regex(text, pat) END AS gaps,
  CASE WHEN pat IS NULL THEN [] ELSE regexp_extract_all(text, pat) END AS got
  FROM hops LEFT JOIN pats USING (conv_id) WHERE conv_id % 7 <> 0),
out AS (
  SELECT conv_id, 0 AS part, 0 AS hop, 'MISMATCH: ' || leaks || ' leaks: ' || refs AS line FROM n WHERE leaks > 0
  UNION ALL SELECT conv_id, 0, 0, 'MISMATCH: ' || bad || ' defects: ' || refs FROM d WHERE bad > 0
  UNION ALL SELECT conv_id, 1, 0, 'capture ' || conv_id || ': in flight, no footer yet, nothing to compare' FROM every WHERE conv_id % 7 = 0
  UNION ALL SELECT conv_id, 1, 0, 'capture ' || conv_id || ': messages' FROM done
  UNION ALL SELECT conv_id, 2, turn, 'hop ' || turn || ' (' || role || '): ' || list_aggregate(list_transform(range(1, len(gaps) + 1),
    lambda i: gaps[i] || CASE WHEN i <= len(got) THEN '[' || got[i] || ' -> S-' || lower(got[i]) || ']' ELSE '' END), 'string_agg', '') FROM marked
  UNION ALL SELECT conv_id, 2, turn, '  reconstructed by dictionary at ' || s || '-' || e || ': ' || word FROM again
  UNION ALL SELECT done.conv_id, 3, 0, 'summary: outcome passed, ' || coalesce(n, 0) || ' values injected, ' || coalesce(leaks, 0) || ' leaks' FROM done LEFT JOIN n USING (conv_id)
  UNION ALL SELECT conv_id, 3, 0, '  note: no adjudicator took part in the replay' FROM ran WHERE conv_id % 2 = 0
  UNION ALL SELECT conv_id, 4, 0, CASE WHEN conv_id IN (SELECT conv_id FROM ran) THEN '  comparison: no divergence' ELSE '  comparison: not run, there is no reconstructed section' END
    FROM done WHERE conv_id NOT IN (SELECT conv_id FROM d)
  UNION ALL SELECT conv_id, 4, 0, '  divergence ' || severity || ': S-' || lower(word) FROM differ)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = language.hops(spark, sf_dir)
    titled = candidates.title_tokens(dictionary.tokens(turns, "hop")).where(F.length("word") >= 6)
    titled = titled.join(turns.select("hop", "conv_id", "turn"), "hop").select(F.col("conv_id").alias("capture_id"), F.col("turn").alias("hop"), "s", "e", "word")
    titled = materialize(titled, "report-words")
    surrogate = F.concat(F.lit("S-"), F.lower("word"))
    injected = titled.select("capture_id", F.col("word").alias("real"), surrogate.alias("surrogate")).distinct()
    replayed = titled.where("capture_id % 5 <> 0 AND length(word) % 2 = 0").withColumn("pass_name", F.lit("dictionary"))
    again = replayed.select("capture_id", surrogate.alias("surrogate"), F.col("word").alias("real")).distinct()
    in_graph = table(spark, sf_dir, "benchmark").select(F.explode(words.words(F.col("text"))).alias("real"))
    exchanges = turns.select(F.col("conv_id").alias("capture_id")).distinct().select(
        "capture_id", F.lit("messages").alias("endpoint"), F.expr("CASE WHEN capture_id % 7 <> 0 THEN 'passed' END").alias("outcome"),
        (F.col("capture_id") % 2 == 1).alias("adjudicated"))
    spoken = turns.select(F.col("conv_id").alias("capture_id"), F.col("turn").alias("hop"), F.col("role").alias("kind"), "text")
    divergences = records.compare(injected.select("capture_id", "surrogate", "real"), again, in_graph)
    return explain.report_lines(exchanges, spoken, injected, injected.where("length(real) = 9"), divergences, replayed)


@_query("explain_lines", f"WITH {REPORT_SQL} SELECT conv_id AS capture_id, part, hop, line FROM out")
def explain_lines(spark, sf_dir):
    return _report(spark, sf_dir).select("capture_id", "part", "hop", "line")


@_query(
    "explain_reports",
    f"""WITH {REPORT_SQL} SELECT conv_id AS capture_id, bool_or(part = 0) AS banner, min(line) FILTER (part = 1) AS head,
sum(length(line)) + count(*) - 1 AS n_chars FROM out GROUP BY conv_id""",
)
def explain_reports(spark, sf_dir):
    """Whole reports: is there a banner on top, the line of the capture, and their sizes."""
    banner = F.col("report").startswith("MISMATCH")
    head = F.regexp_extract("report", r"(?m)^capture .*$", 0)
    found = explain.reports(_report(spark, sf_dir))
    return found.select("capture_id", banner.alias("banner"), head.alias("head"), F.length("report").alias("n_chars"))


@_query(
    "seed_csv_import",
    f"WITH {ENTITIES} SELECT kind, canonical AS value, lower(canonical) || '|' || upper(canonical) AS variations, 'seen' AS relation FROM entities",
)
def seed_csv_import(spark, sf_dir):
    """All entities written as seed files and read again: blanks and empty variations go."""
    path = new_path(spark, "seed")
    variations = F.concat(F.lit(" "), F.lower("canonical"), F.lit(" ;; "), F.upper("canonical"))
    rows = entities(spark, sf_dir).select("kind", F.concat(F.lit("  "), "canonical").alias("value"), variations.alias("variations"), F.lit("seen").alias("relation"), F.lit("").alias("target"))
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_seed_csv(spark, path).select("kind", "value", F.array_join("variations", "|").alias("variations"), "relation")


@_query(
    "word_list_scan",
    f"""WITH {language.HOPS_SQL}, {language.TOKENS_SQL}, listed AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{words.WORD}'))) AS word FROM benchmark)
SELECT hop, count(*) FILTER (lower(word) IN (SELECT word FROM listed)) AS n_listed, count(*) AS n FROM toks GROUP BY hop""",
)
def word_list_scan(spark, sf_dir):
    """The words of all items as a list file with comments and blank lines; words of turns that the list holds."""
    path = new_path(spark, "list")
    listed = table(spark, sf_dir, "benchmark").select(F.explode(words.words(F.lower("text"))).alias("word"))
    listed.select(F.concat(F.lit("# a comment\n\n "), "word", F.lit(" ")).alias("value")).write.text(path)
    known = files.read_word_list(spark, path).withColumn("listed", F.lit(True))
    toks = dictionary.tokens(language.hops(spark, sf_dir), "hop").select("hop", F.lower("word").alias("word"))
    return toks.join(known, "word", "left").groupBy("hop").agg(F.count("listed").alias("n_listed"), F.count("*").alias("n"))

"""Queries on tables as they were at a time: versions, as-of joins, replays of turns.

Events are the log of a table by user. Benchmark names, surrogates and items get a history by their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators import captures, history, replay
from maskwell.plans import language, passes
from maskwell.plans.pii import BEYOND, KINDS, table
from maskwell.shared import materialize

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
STOP = language.STOP


def _query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return register


VERSIONS_SQL = """log AS (SELECT *, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events),
kept AS (SELECT event_id, user_id, event_type, valid_from, valid_to FROM log WHERE event_type <> 'error' AND (valid_to IS NULL OR valid_from < valid_to))"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of a user's last event is what holds for the user; an error ends it."""
    changes = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", (F.col("event_type") == "error").alias("removed"))
    return history.versions(changes, ["user_id"], at="ts", order="event_id")


@_query("mapping_versions", f"WITH {VERSIONS_SQL} SELECT * FROM kept")
def mapping_versions(spark, sf_dir):
    ends = {c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")}
    return _versions(spark, sf_dir).withColumns(ends)


@_query(
    "mapping_as_of",
    f"""WITH {VERSIONS_SQL} SELECT e.event_id, k.event_id AS version, k.event_type AS state FROM events e JOIN kept k USING (user_id)
WHERE k.valid_from <= e.ts - INTERVAL 1 HOUR AND (k.valid_to IS NULL OR e.ts - INTERVAL 1 HOUR < k.valid_to)""",
)
def mapping_as_of(spark, sf_dir):
    """What held for the user of every event an hour before it."""
    kept = materialize(_versions(spark, sf_dir), "versions").withColumnRenamed("event_id", "version")
    asked = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 HOUR")).alias("at"))
    found = history.as_of(asked, kept, ["user_id"], "at")
    return found.select("event_id", "version", F.col("event_type").alias("state"))


# Turns are sent on one of 30 days. Two of three names of an entity hold for 15 days, the third one from its day on;
# all entities get other surrogates on the 12th day; items of even numbers are open for 14 days, others stay.
_DAY = "(TIMESTAMP '2024-01-01' + to_days(({})::INT))"
_TURNS = f"(SELECT conv_id * 1000 + turn AS leaf, text, {_DAY.format('conv_id % 30')} AS sent FROM conversations)"
_FUZZY = language.FUZZY_SQL.replace(" AND folded NOT IN (SELECT lookup FROM fo)", "")
REPLAY_SQL = f"""{language.keyed_sql(_TURNS, "leaf")}, {_FUZZY}, {passes.SURROGATES_SQL}, {passes.ITEMS_SQL},
turns AS {_TURNS},
dated AS (SELECT surface, entity, ord, {_DAY.format('entity % 10')} AS f, CASE WHEN ord % 3 <> 2 THEN {_DAY.format('entity % 10 + 15')} END AS t FROM dict),
links AS (SELECT phrase, surface, CASE WHEN phrase = surface THEN 0 ELSE 1 END AS rank, 0 AS dist
    FROM phrases JOIN (SELECT DISTINCT surface, {language._fold_sql('surface')} AS lookup FROM dict) ON folded = lookup
  UNION ALL SELECT DISTINCT phrase, surface, 2, dist FROM close),
cand AS (SELECT w.leaf, w.s, w.e, w.phrase, rank, dist, surface, entity, ord FROM wins w JOIN turns USING (leaf) JOIN links USING (phrase) JOIN dated USING (surface)
  WHERE sent >= f AND (t IS NULL OR sent < t)),
per_window AS (SELECT leaf, s, e, arg_min((surface, entity), (rank, dist, ord)) AS m FROM cand GROUP BY leaf, s, e),
matched AS (SELECT leaf, s, e, m[1] AS surface, m[2] AS entity, '' AS pass_name FROM per_window), {language.kept_sql("leaf")},
days AS (SELECT DISTINCT sent FROM turns),
open AS (SELECT sent, item_id, value, surrogate FROM items JOIN days ON sent >= {_DAY.format('item_id % 7')} AND (item_id % 2 = 1 OR sent < {_DAY.format('item_id % 7 + 14')})),
words AS (SELECT sent, item_id, unnest(string_split(value, ' ')) AS word, unnest(string_split(surrogate, ' ')) AS target FROM open),
meant AS (SELECT sent, word, min(target) AS target FROM words WHERE lower(word) NOT IN ({language._in(STOP)}) GROUP BY sent, word HAVING count(DISTINCT target) = 1),
known AS (SELECT sent, item_id, value, surrogate, value AS real FROM open
  UNION ALL SELECT DISTINCT sent, item_id, word, m.target, word FROM words JOIN meant m USING (sent, word)),
every AS (SELECT leaf, s, e, 0 AS layer, 0 AS rank, CASE WHEN sent < {_DAY.format('12')} THEN surrogate ELSE 'Haus ' || entity END AS surrogate, canonical AS real
    FROM l2 JOIN turns USING (leaf) JOIN surrogates USING (entity)
  UNION ALL SELECT w.leaf, w.s, w.e, 1, k.item_id, k.surrogate, k.real FROM wins w JOIN turns USING (leaf) JOIN known k ON k.sent = turns.sent AND w.phrase = k.value AND w.e - w.s = length(k.value)),
{passes.choice_sql("leaf")}"""


def _day(number: str) -> Column:
    return F.expr(f"TIMESTAMP '2024-01-01' + make_dt_interval(cast({number} AS int))")


def _changes(rows: DataFrame, by: str, since: str, until: str, ends: str) -> DataFrame:
    """Versions of a table whose rows come on day ``since`` and, where ``ends`` holds, go on day ``until``."""
    come = rows.withColumns({"at": _day(since), "removed": F.lit(False)})
    go = rows.where(ends).withColumns({"at": _day(until), "removed": F.lit(True)})
    return materialize(history.versions(come.unionByName(go), [by]), "versions")


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all turns: ``leaf``, ``s``, ``e``, ``layer``, ``surrogate``, ``real``."""
    names, surrogates, items = passes._names(spark, sf_dir)
    names = _changes(names, "ord", "entity % 10", "entity % 10 + 15", "ord % 3 <> 2")
    items = _changes(items, "item_id", "item_id % 7", "item_id % 7 + 14", "item_id % 2 = 0")
    first = surrogates.withColumns({"at": F.lit(None).cast("timestamp"), "removed": F.lit(False)})
    edited = surrogates.withColumns({"at": _day("12"), "removed": F.lit(False), "surrogate": F.concat(F.lit("Haus "), "entity")})
    surrogates = materialize(history.versions(first.unionByName(edited), ["entity"]), "versions")
    turns = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn AS leaf"), "text", _day("conv_id % 30").alias("at"))
    return replay.spans_as_of(turns, "leaf", "at", names, surrogates, items, STOP, kinds=KINDS, beyond=BEYOND)


@_query(
    "replay_as_of",
    f"""WITH {REPLAY_SQL} SELECT leaf, 'detection' AS record, 'reconstructed' AS section, 0 AS l1_count, count(*) FILTER (layer = 'dictionary') AS l2_count,
  list_aggregate(list_sort(list(DISTINCT surrogate)), 'string_agg', ',') AS surrogates, string_agg(s || '-' || e, ',' ORDER BY s, e) AS offsets FROM chosen GROUP BY leaf""",
)
def replay_as_of(spark, sf_dir):
    """Detection records of every turn, replayed with the dictionary, surrogates and review items of its own day."""
    chosen = materialize(_replayed(spark, sf_dir), "replayed").withColumn("hop", F.lit(0))
    return captures.detection_records(chosen, "leaf", "hop").drop("hop")

"""Queries on the review loop, stored tables and recorded exchanges.

Parts, customers, suppliers, nations, orders, events and conversations stand in for their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.functions.crypto import decrypt, encrypt
from maskwell.operators import candidates, captures, graph, minting, passes, review, store
from maskwell.operators.ordinal import with_ordinal
from maskwell.operators.stored import StoredTable, verdicts
from maskwell.plans import language
from maskwell.plans.pii import table
from maskwell.plans.records import CIPHER_KEY, EDGES, ENTITIES, edges, entities
from maskwell.shared import new_path
from maskwell.sources import files, payloads
from maskwell.streaming import views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
STOP = language.STOP


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Open items: names of the odd parts, numbered by first appearance; those of even parts are found later.
INBOX_SQL = """inbox AS (SELECT row_number() OVER (ORDER BY first) AS item_id, p_name AS value, 'term' AS entity_type, 'w' || first % 3 AS workspace FROM
  (SELECT p_name, min(p_partkey) AS first FROM part WHERE p_partkey % 2 = 1 GROUP BY p_name))"""
POOL = minting.POOLS["term"]


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = table(spark, sf_dir, "part").where("p_partkey % 2 = 1").groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    listed = early.selectExpr("first", "p_name AS value", "'term' AS entity_type", "concat('w', first % 3) AS workspace")
    numbered = minting.inbox(listed, ["first"]).join(listed.select("value", "workspace"), "value")
    return numbered.withColumn("surrogate", F.concat(F.lit("Alt"), "item_id")).select(*review.INBOX)


@_query(
    "inbox_upsert",
    f"""WITH {INBOX_SQL}, fresh AS (SELECT p_name AS value, row_number() OVER (ORDER BY min(p_partkey)) AS nth FROM part WHERE p_name NOT IN (SELECT value FROM inbox) GROUP BY p_name)
SELECT item_id, value, 'Alt' || item_id AS surrogate FROM inbox UNION ALL
SELECT nth + (SELECT max(item_id) FROM inbox), value, coalesce({_list(POOL)}[nth], 'BFT' || printf('%04d', nth - 1 - {len(POOL)})) FROM fresh""",
)
def inbox_upsert(spark, sf_dir):
    """Names of all parts come in: those that are open keep their item, the others go on."""
    open_items = inbox(spark, sf_dir)
    found = table(spark, sf_dir, "part").selectExpr("'w0' AS workspace", "'term' AS entity_type", "p_name AS value", "p_partkey")
    known = review.known_values(spark.createDataFrame([], "real string, surrogate string, active boolean"), open_items)
    grown = review.upsert(open_items, found, minting.pool_table(spark, {"term": POOL}), known, ["p_partkey"])
    return grown.select("item_id", "value", "surrogate")


@_query(
    "review_confirm",
    f"""WITH {INBOX_SQL}, done AS (SELECT * FROM inbox WHERE item_id % 3 = 0)
SELECT 'inbox' AS place, value, 'Alt' || item_id AS surrogate FROM inbox WHERE item_id % 3 <> 0
UNION ALL SELECT 'entities', value, 'Alt' || item_id FROM done UNION ALL SELECT 'mapping', value, 'Alt' || item_id FROM done UNION ALL SELECT 'cells', value, 'Alt' || item_id FROM done""",
)
def review_confirm(spark, sf_dir):
    """Every third item is confirmed: out of the inbox, into graph, mapping and the encrypted store."""
    items = inbox(spark, sf_dir)
    done = review.confirm(items, items.where("item_id % 3 = 0"), CIPHER_KEY)
    value = {"inbox": F.col("value"), "entities": F.col("canonical"), "mapping": F.col("real"), "cells": decrypt(F.col("cell"), CIPHER_KEY, F.col("workspace"))}
    parts = [done[place].select(F.lit(place).alias("place"), value[place].alias("value"), "surrogate") for place in value]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@_query("review_reject", f"WITH {INBOX_SQL} SELECT CASE WHEN item_id % 3 = 1 THEN 'allowed' ELSE 'inbox' END AS place, value FROM inbox UNION ALL SELECT 'allowed', 'the'")
def review_reject(spark, sf_dir):
    items = inbox(spark, sf_dir)
    done = review.reject(items, items.where("item_id % 3 = 1"), spark.range(1).select(F.lit("the").alias("word")))
    return done["inbox"].select(F.lit("inbox").alias("place"), "value").union(done["allowed"].select(F.lit("allowed"), "word"))


@_query("inbox_hydrate", f"WITH {INBOX_SQL} SELECT item_id, value FROM inbox WHERE value NOT IN (SELECT p_name FROM part WHERE p_partkey < 20 AND p_partkey % 7 = 0)")
def inbox_hydrate(spark, sf_dir):
    """Stored items decrypted; those that are live surrogates, here names of some of the same parts, are purged."""
    items = inbox(spark, sf_dir)
    cells = items.withColumn("cell", encrypt(F.col("value"), CIPHER_KEY, F.col("workspace"))).drop("value")
    live = table(spark, sf_dir, "part").where("p_partkey < 20 AND p_partkey % 7 = 0").select(F.col("p_name").alias("surrogate"))
    return review.hydrate(cells, CIPHER_KEY, live.distinct()).select("item_id", "value")


@_query("mapping_hydrate", "SELECT s_name AS real, 'T' || s_suppkey AS surrogate, true AS active FROM supplier")
def mapping_hydrate(spark, sf_dir):
    terms = entities(spark, sf_dir).where("kind = 'term'")
    return review.hydrate_mapping(store.reidentify_cells(terms, CIPHER_KEY), CIPHER_KEY)


@_query(
    "transcript_mining",
    f"""WITH {language.HOPS_SQL}, {language.TOKENS_SQL}, known AS (SELECT unnest(regexp_extract_all(text, '{words.WORD}')) AS word FROM benchmark)
SELECT word AS value, min((hop, s))[1] AS first_key, min((hop, s))[2] AS first_at, count(*) AS n FROM toks
WHERE regexp_matches(word, '{words.TITLE}') AND lower(word) NOT IN ({language._in(STOP)}) AND word NOT IN (SELECT word FROM known) AND length(word) > 7 GROUP BY word""",
)
def transcript_mining(spark, sf_dir):
    """Confirmed names of all conversations; a rule on their length stands in for a model."""
    known = table(spark, sf_dir, "benchmark").select(F.explode(words.words(F.col("text"))).alias("word"))
    return review.mine(language.hops(spark, sf_dir), "hop", known, STOP, lambda word, context: F.length(word) > 7)


@_query(
    "learn_disjoint",
    f"""WITH base AS (SELECT DISTINCT p_name AS real, 'Haus ' || upper(p_name) AS surrogate FROM part), fresh AS (SELECT * FROM (VALUES (0, 'RED', 'Neu1'), (1, 'BLUE', 'Neu2')) t(ord, real, surrogate)),
every AS (SELECT *, -1 AS ord FROM base UNION ALL SELECT real, surrogate, ord FROM fresh),
hit AS (SELECT real, surrogate, ord, EXISTS (SELECT 1 FROM fresh f WHERE contains(e.surrogate, f.real) AND f.real <> e.real) AS hit FROM every e),
again AS (SELECT real, row_number() OVER (ORDER BY ord, real) - 1 AS k FROM hit WHERE hit)
SELECT real, surrogate, NOT hit AS active FROM hit UNION ALL SELECT real, coalesce({_list(['Ersatz Eins', 'Ersatz Zwei'])}[k + 1], 'BFR' || printf('%04d', k - 2)), true FROM again""",
)
def learn_disjoint(spark, sf_dir):
    """Two new real values stand inside surrogates given before: those retire and are replaced."""
    base = table(spark, sf_dir, "part").select(F.col("p_name").alias("real"), F.concat(F.lit("Haus "), F.upper("p_name")).alias("surrogate"), F.lit(True).alias("active")).distinct()
    fresh = spark.createDataFrame([(0, "RED", "Neu1"), (1, "BLUE", "Neu2")], "ord long, real string, surrogate string")
    return review.learn(base, fresh, ["Ersatz Eins", "Ersatz Zwei"])


@_query(
    "pool_corpus_collisions",
    f"""WITH pool AS (SELECT DISTINCT w[1] || ' ' || w[2] AS entry FROM (SELECT regexp_extract_all(text, '{words.WORD}') AS w FROM benchmark)),
own AS (SELECT entry, unnest(regexp_extract_all(lower(entry), '{words.WORD}')) AS word FROM pool),
used AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{words.WORD}')) AS word FROM conversations)
SELECT DISTINCT entry FROM own WHERE word NOT IN ({language._in(STOP)}) AND word IN (SELECT word FROM used)""",
)
def pool_corpus_collisions(spark, sf_dir):
    pool = table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", F.slice(words.words(F.col("text")), 1, 2)).alias("entry")).distinct()
    return review.corpus_collisions(pool, table(spark, sf_dir, "conversations"), STOP)


@_query(
    "surrogate_edit",
    """WITH m AS (SELECT s_suppkey, s_name AS real, 'T' || s_suppkey AS surrogate FROM supplier), n AS (SELECT count(*) AS n FROM supplier),
edit AS (SELECT real, CASE WHEN s_suppkey % 2 = 0 THEN 'X' || s_suppkey ELSE 'T' || (s_suppkey + 1) END AS surrogate FROM m WHERE s_suppkey % 5 < 2),
good AS (SELECT * FROM edit WHERE surrogate NOT IN (SELECT surrogate FROM m))
SELECT m.real, m.surrogate, good.real IS NULL AS active FROM m LEFT JOIN good USING (real) UNION ALL SELECT real, surrogate, true FROM good""",
)
def surrogate_edit(spark, sf_dir):
    """Edits to free surrogates retire the old one, edits to taken ones are not applied."""
    rows = table(spark, sf_dir, "supplier")
    mapping = rows.selectExpr("s_name AS real", "concat('T', s_suppkey) AS surrogate", "true AS active")
    edits = rows.where("s_suppkey % 5 < 2").selectExpr("s_name AS real", "CASE WHEN s_suppkey % 2 = 0 THEN concat('X', s_suppkey) ELSE concat('T', s_suppkey + 1) END AS surrogate")
    return review.edit_surrogates(mapping, edits)


@_query(
    "merge_side_effects",
    """SELECT s_name AS real, CASE WHEN s_suppkey % 10 = 1 THEN 'T' || (s_suppkey - 1) ELSE 'T' || s_suppkey END AS surrogate, true AS active FROM supplier
UNION ALL SELECT s_name, 'T' || s_suppkey, false FROM supplier WHERE s_suppkey % 10 = 1""",
)
def merge_side_effects(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    mapping = rows.selectExpr("s_name AS real", "concat('T', s_suppkey) AS surrogate", "true AS active")
    merged = rows.where("s_suppkey % 10 = 1").selectExpr("s_name AS real", "concat('T', s_suppkey - 1) AS surrogate")
    return review.follow_merge(mapping, merged)


@_query("merge_by_name", f"WITH {ENTITIES} SELECT a.entity_id AS winner_id, b.entity_id AS loser_id FROM entities a JOIN entities b ON a.workspace = b.workspace AND a.kind = b.kind AND b.entity_id = a.entity_id + 25 AND a.kind = 'person'")
def merge_by_name(spark, sf_dir):
    """Pairs of customers of one nation named by their names; those that are not there are left out."""
    people = entities(spark, sf_dir).where("kind = 'person'")
    named = people.selectExpr("workspace", "kind", "canonical AS winner", "concat('Customer#', lpad(entity_id + 25, 9, '0')) AS loser")
    return store.merge_by_name(people, named)


BUNDLE_SQL = """bundle AS (SELECT 'w' || n_regionkey AS workspace, CASE WHEN n_nationkey % 2 = 0 THEN 'person' ELSE 'term' END AS kind, n_name AS canonical, [lower(n_name), n_name] AS variations, n_nationkey AS ord FROM nation)"""


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('w', n_regionkey) AS workspace", "CASE WHEN n_nationkey % 2 = 0 THEN 'person' ELSE 'term' END AS kind", "n_name AS canonical",
        "array(lower(n_name), n_name) AS variations", "n_nationkey AS ord")


@_query(
    "seed_pairs",
    f"""WITH {BUNDLE_SQL}, named AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord) AS k FROM bundle),
minted AS (SELECT *, CASE kind WHEN 'person' THEN {_list(minting.POOLS['person'])}[k] ELSE {_list(POOL)}[k] END AS surrogate FROM named)
SELECT workspace, surface, surrogate FROM (SELECT workspace, canonical AS surface, surrogate FROM minted UNION ALL SELECT workspace, lower(canonical), surrogate FROM minted)""",
)
def seed_pairs(spark, sf_dir):
    return store.seed_pairs(bundle(spark, sf_dir), minting.pool_table(spark, {k: minting.POOLS[k] for k in ("person", "term")}))


@_query("import_row_count", f"WITH {BUNDLE_SQL} SELECT kind, canonical, count(*) OVER (PARTITION BY kind) AS n_rows FROM bundle")
def import_row_count(spark, sf_dir):
    return store.import_counts(bundle(spark, sf_dir)).select("kind", "canonical", "n_rows")


@_query(
    "seed_commit",
    f"""WITH {ENTITIES}, {EDGES} SELECT 'entity' AS what, canonical AS a, workspace AS b FROM entities
UNION ALL SELECT DISTINCT 'edge', relation || ' ' || source_id, target_id::VARCHAR FROM edges JOIN entities s ON s.entity_id = source_id JOIN entities t ON t.entity_id = target_id
  WHERE (relation = 'employer' AND s.kind = 'person' AND t.kind = 'term') OR (relation = 'subsidiary_of' AND s.kind = 'term' AND t.kind = 'term')""",
)
def seed_commit(spark, sf_dir):
    """A bundle loaded twice over a part of itself: nothing doubles, bad edges stay out."""
    every, links = entities(spark, sf_dir), edges(spark, sf_dir)
    there = every.where("entity_id % 3 = 0")
    once = store.seed_commit(there, links.limit(0), every, links)
    twice = store.seed_commit(*once, every, links)
    rows = twice[0].select(F.lit("entity").alias("what"), F.col("canonical").alias("a"), F.col("workspace").alias("b"))
    return rows.unionByName(twice[1].select(F.lit("edge").alias("what"), F.concat_ws(" ", "relation", "source_id").alias("a"), F.col("target_id").cast("string").alias("b")))


@_query("reidentify_cells", "SELECT 'T' || s_suppkey AS surrogate, 'w' || s_nationkey AS workspace, s_name AS plain, true AS hidden FROM supplier")
def reidentify_cells(spark, sf_dir):
    cells = store.reidentify_cells(entities(spark, sf_dir).where("kind = 'term'"), CIPHER_KEY)
    cells = StoredTable.create(cells, new_path(spark, "cells"), ["surrogate", "workspace"]).rows()
    hidden = F.col("cell").startswith(store.CELL_PREFIX) & ~F.col("cell").contains("Supplier")
    return cells.select("surrogate", "workspace", decrypt(F.col("cell"), CIPHER_KEY, F.col("workspace")).alias("plain"), hidden.alias("hidden"))


@_query(
    "graph_hydrate",
    f"""WITH {ENTITIES}, {EDGES}, mine AS (SELECT * FROM entities WHERE entity_id % 4 <> 3),
e AS (SELECT source_id, count(*) AS n FROM edges WHERE source_id IN (SELECT entity_id FROM mine) AND target_id IN (SELECT entity_id FROM mine) GROUP BY source_id)
SELECT entity_id, canonical, canonical || ',' || variations[1] AS variations, coalesce(n, 0) AS n_out FROM mine LEFT JOIN e ON source_id = entity_id""",
)
def graph_hydrate(spark, sf_dir):
    """Encrypted rows back to entities; edges to entities that are gone are dropped."""
    mine = entities(spark, sf_dir).where("entity_id % 4 <> 3")
    stored = mine.select("workspace", "entity_id", "kind", encrypt(F.col("canonical"), CIPHER_KEY, F.col("workspace")).alias("cell"), "surrogate")
    names = graph.surfaces(mine).select("workspace", "entity_id", "ord", encrypt(F.col("surface"), CIPHER_KEY, F.col("workspace")).alias("cell"))
    whole, links = store.hydrate_graph(stored, names, edges(spark, sf_dir), CIPHER_KEY)
    out = links.groupBy(F.col("source_id").alias("entity_id")).agg(F.count("*").alias("n_out"))
    return whole.join(out, "entity_id", "left").select("entity_id", "canonical", F.array_join("variations", ",").alias("variations"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


@_query(
    "plaintext_refusal",
    """SELECT 'persons' AS "table", count(*) AS n_rows, count(*) FILTER (c_custkey % 11 = 0) AS n_plain, true AS refused FROM customer
UNION ALL SELECT 'terms', count(*), 0, false FROM supplier""",
)
def plaintext_refusal(spark, sf_dir):
    every = entities(spark, sf_dir)
    cell = encrypt(F.col("canonical"), CIPHER_KEY, F.col("workspace"))
    persons = every.where("kind = 'person'").select(F.when(F.col("entity_id") % 11 == 0, F.col("canonical")).otherwise(cell).alias("cell"))
    return store.plaintext_cells({"persons": persons, "terms": every.where("kind = 'term'").select(cell.alias("cell"))})


@_query(
    "edge_create_delete",
    f"""WITH {ENTITIES}, {EDGES}, good AS (SELECT DISTINCT source_id, relation, target_id FROM edges JOIN entities s ON s.entity_id = source_id JOIN entities t ON t.entity_id = target_id
  WHERE (relation = 'employer' AND s.kind = 'person' AND t.kind = 'term') OR (relation = 'subsidiary_of' AND s.kind = 'term' AND t.kind = 'term'))
SELECT 'kept' AS what, relation, count(*) AS n FROM good WHERE source_id % 2 = 0 GROUP BY relation UNION ALL
SELECT 'refused', relation, count(*) FROM edges e WHERE (source_id, relation, target_id) NOT IN (SELECT (source_id, relation, target_id) FROM good) GROUP BY relation""",
)
def edge_create_delete(spark, sf_dir):
    """Edges of the vocabulary are made, others refused; then those of odd sources are deleted."""
    links = edges(spark, sf_dir)
    made, refused = store.create_edges(links.limit(0), links, entities(spark, sf_dir).select("entity_id", "kind"))
    made = StoredTable.create(made, new_path(spark, "edges"), ["source_id", "relation", "target_id"])
    kept = made.deleted(links.where("source_id % 2 = 1")).rows()
    count = lambda rows, what: rows.groupBy("relation").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "relation", "n")
    return count(kept, "kept").unionByName(count(refused, "refused"))


@_query(
    "grant_revoke",
    """SELECT DISTINCT 'u' || c_custkey % 50 AS identity, 'w' || c_nationkey AS workspace, c_mktsegment AS role FROM customer
EXCEPT SELECT 'u' || c_custkey % 50, 'w' || c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 9 = 0""",
)
def grant_revoke(spark, sf_dir):
    triples = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('u', c_custkey % 50) AS identity", "concat('w', c_nationkey) AS workspace", "c_mktsegment AS role")
    keys = ["identity", "workspace", "role"]
    grants = StoredTable.create(triples.where("c_custkey % 2 = 0").select(*keys), new_path(spark, "grants"), keys)
    return grants.upserted(triples.select(*keys)).deleted(triples.where("c_custkey % 9 = 0")).rows()


@_query("workspace_create", "SELECT 'w' || n_nationkey AS slug, CASE WHEN n_nationkey < 10 THEN n_name ELSE lower(n_name) END AS name FROM nation")
def workspace_create(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    there = rows.where("n_nationkey < 10").selectExpr("concat('w', n_nationkey) AS slug", "n_name AS name")
    return store.create_workspaces(there, rows.selectExpr("concat('w', n_nationkey) AS slug", "lower(n_name) AS name"))


@_query("settings_write", "SELECT 'w' || n_nationkey AS workspace, n_nationkey % 3 = 0 AS deterministic_only, n_nationkey % 3 <> 0 AS phone_candidates_enabled FROM nation")
def settings_write(spark, sf_dir):
    """Both flags of every workspace are replaced; the last write counts."""
    rows = table(spark, sf_dir, "nation")
    old = rows.where("n_nationkey < 5").selectExpr("concat('w', n_nationkey) AS workspace", "true AS deterministic_only", "true AS phone_candidates_enabled")
    new = rows.selectExpr("concat('w', n_nationkey) AS workspace", "n_nationkey % 3 = 0 AS deterministic_only", "n_nationkey % 3 <> 0 AS phone_candidates_enabled", "1 AS seq")
    stale = new.selectExpr("workspace", "NOT deterministic_only AS deterministic_only", "true AS phone_candidates_enabled", "0 AS seq")
    settings = StoredTable.create(old, new_path(spark, "settings"), ["workspace"])
    return settings.upserted(new.unionByName(stale), order="seq").rows()


@_query(
    "role_units",
    """WITH want AS (SELECT DISTINCT 'w' || c_nationkey AS workspace, c_mktsegment AS unit FROM customer), there AS (SELECT workspace, unit, row_number() OVER (ORDER BY workspace, unit) AS unit_id FROM want WHERE workspace < 'w2'),
every AS (SELECT * FROM there UNION ALL SELECT workspace, unit, row_number() OVER (ORDER BY workspace, unit) + coalesce((SELECT max(unit_id) FROM there), 0) FROM want WHERE workspace >= 'w2')
SELECT DISTINCT c_custkey AS person_id, unit_id, 'member' AS role FROM customer JOIN every ON workspace = 'w' || c_nationkey AND unit = c_mktsegment""",
)
def role_units(spark, sf_dir):
    """Roles in org units; a unit that is not there yet is made."""
    new = table(spark, sf_dir, "customer").selectExpr("concat('w', c_nationkey) AS workspace", "c_custkey AS person_id", "c_mktsegment AS unit", "'member' AS role")
    there = new.where("workspace < 'w2'").select("workspace", "unit", F.lit(0).alias("_all")).distinct()
    units = with_ordinal(there, ["_all"], ["workspace", "unit"]).select("workspace", (F.col("ordinal") + 1).alias("unit_id"), "unit")
    none = new.select("workspace", "person_id", F.lit(0).cast("long").alias("unit_id"), "role").limit(0)
    return store.assign_roles(units, none, new)[1].select("person_id", "unit_id", "role")


@_query("entity_keys", f"WITH {ENTITIES} SELECT kind || ':' || entity_id AS entity_key, kind, entity_id AS row_id FROM entities")
def entity_keys(spark, sf_dir):
    keyed = entities(spark, sf_dir).select(store.entity_key(F.col("kind"), F.col("entity_id")).alias("entity_key"))
    return keyed.select("entity_key", store.parse_entity_key(F.col("entity_key")).alias("p")).select("entity_key", "p.*")


_CAPTURES_SQL = "(SELECT event_id, user_id, strftime(ts, '%Y%m%dT%H%M%S') || '-' || substr(sha256(event_id::VARCHAR), 1, 8) AS capture_id FROM events)"


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", captures.capture_id(F.col("ts"), F.col("event_id")).alias("capture_id"))


@_query("capture_ids", f"SELECT event_id, capture_id FROM {_CAPTURES_SQL}")
def capture_ids(spark, sf_dir):
    return _captures(spark, sf_dir).select("event_id", "capture_id")


@_query("latest_capture", f"SELECT user_id, max(capture_id) AS capture_id FROM {_CAPTURES_SQL} GROUP BY user_id")
def latest_capture(spark, sf_dir):
    return captures.latest(_captures(spark, sf_dir), ["user_id"])


@_query(
    "dismissal_log",
    f"""WITH {language.HOPS_SQL}, {language.TOKENS_SQL} SELECT DISTINCT word FROM toks WHERE regexp_matches(word, '{words.TITLE}') AND length(word) <= 5
  AND word NOT IN (SELECT unnest(regexp_extract_all(text, '{words.WORD}')) FROM benchmark)""",
)
def dismissal_log(spark, sf_dir):
    """Refused candidates, once each, but for those that were logged: the words of the benchmark."""
    titled = candidates.title_tokens(language.hop_tokens(spark, sf_dir))
    logged = table(spark, sf_dir, "benchmark").select(F.explode(words.words(F.col("text"))).alias("word")).distinct()
    return captures.dismissals(titled.select("word", (F.length("word") > 5).alias("confirmed")), logged)


@_query("capture_annotation", "SELECT p_partkey, 'see [' || p_name || ' -> T' || p_partkey || '] and [' || p_brand || ' -> B] of size ' || p_size AS text FROM part")
def capture_annotation(spark, sf_dir):
    pair = lambda real, surrogate: F.struct(real.alias("real"), surrogate.alias("surrogate"))
    rows = table(spark, sf_dir, "part")
    injected = F.array(pair(F.col("p_name"), F.concat(F.lit("T"), "p_partkey")), pair(F.col("p_brand"), F.lit("B")))
    text = F.concat(F.lit("see "), "p_name", F.lit(" and "), "p_brand", F.lit(" of size "), "p_size")
    return rows.select("p_partkey", captures.annotate(text, injected).alias("text"))


_LAYER = "CASE WHEN length(word) % 2 = 0 THEN 'contact' ELSE 'dictionary' END"
_REPLAY_SQL = f"""{language.HOPS_SQL}, {language.TOKENS_SQL}, chosen AS (SELECT conv_id, turn AS hop, s, e, word AS surrogate, {_LAYER} AS layer FROM toks t JOIN (SELECT hop AS h, conv_id, turn FROM hops) ON t.hop = h WHERE regexp_matches(word, '{words.TITLE}')),
found AS (SELECT conv_id, hop, count(*) FILTER (layer = 'contact') AS l1_count, count(*) FILTER (layer = 'dictionary') AS l2_count, list_aggregate(list_sort(list(DISTINCT surrogate)), 'string_agg', ',') AS surrogates,
  string_agg(s || '-' || e, ',' ORDER BY s, e) AS offsets FROM chosen GROUP BY ALL)"""


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of each turn serve as the spans of a replay."""
    titled = candidates.title_tokens(language.hop_tokens(spark, sf_dir)).join(language.hops(spark, sf_dir).select("hop", "conv_id", "turn"), "hop")
    layer = F.when(F.length("word") % 2 == 0, "contact").otherwise("dictionary")
    chosen = titled.select("conv_id", F.col("turn").alias("hop"), "s", "e", F.col("word").alias("surrogate"), layer.alias("layer"))
    return captures.detection_records(chosen, "conv_id", "hop")


@_query("replay_records", f"WITH {_REPLAY_SQL} SELECT *, 'detection' AS record, 'reconstructed' AS section FROM found")
def replay_records(spark, sf_dir):
    return _replayed(spark, sf_dir)


@_query("replay_append_once", f"WITH {_REPLAY_SQL} SELECT conv_id, hop, 'reconstructed' AS section, l1_count FROM found WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, 'observed', 0 FROM conversations UNION ALL SELECT conv_id, hop, 'reconstructed', l1_count FROM found WHERE conv_id % 2 = 1")
def replay_append_once(spark, sf_dir):
    """Captures of odd conversations were replayed before and are left alone."""
    found = _replayed(spark, sf_dir).select("conv_id", "hop", "section", "l1_count")
    observed = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("hop"), F.lit("observed").alias("section"), F.lit(0).cast("long").alias("l1_count"))
    before = observed.unionByName(found.where("conv_id % 2 = 1"))
    return captures.append_once(captures.append_once(before, found, "conv_id"), found, "conv_id")


@_query("replay_new_capture", f"WITH {_REPLAY_SQL}, n AS (SELECT conv_id, count(*) AS n FROM found GROUP BY 1) SELECT c.conv_id, coalesce(n, 0) + 3 AS n_lines, coalesce(n, 0) + 2 AS last_line FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id)")
def replay_new_capture(spark, sf_dir):
    payload = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("string").alias("payload"))
    lines = captures.new_capture(payload, _replayed(spark, sf_dir), "conv_id")
    return lines.groupBy("conv_id").agg(F.count("*").alias("n_lines"), F.max("line").alias("last_line"))


@_query("capture_report", f"WITH {_REPLAY_SQL} SELECT conv_id, string_agg('hop ' || hop || ': l1=' || l1_count || ' l2=' || l2_count || ' at ' || offsets, chr(10) ORDER BY hop) || chr(10) || 'total: l1=' || sum(l1_count) || ' l2=' || sum(l2_count) AS report FROM found GROUP BY conv_id")
def capture_report(spark, sf_dir):
    return captures.render(_replayed(spark, sf_dir), "conv_id", "hop")


@_query("verdict_cache_lru", "SELECT md5(user_id || event_type) AS digest, max(event_id) AS last_use FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 100")
def verdict_cache_lru(spark, sf_dir):
    """A cache of a hundred entries after all uses: the limit is the cache's own."""
    uses = table(spark, sf_dir, "events").select(F.md5(F.concat("user_id", "event_type")).alias("digest"), F.col("event_id").alias("n"))
    return captures.cached_verdicts(uses, 100)


@_query("adjudication_errors", "SELECT event_id, CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'click' THEN 'internal' END AS error_class FROM events")
def adjudication_errors(spark, sf_dir):
    name = F.when(F.col("event_type") == "error", "ReadTimeout").when(F.col("event_type") == "click", "ValueError")
    return table(spark, sf_dir, "events").select("event_id", captures.adjudication_error(name).alias("error_class"))


@_query(
    "block_rows",
    """SELECT 'audit' AS place, 'blocked-' || event_type AS a, 'too ' || event_type AS b FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'blocks', event_type, 'too ' || event_type FROM events WHERE event_id % 10 = 0
UNION ALL SELECT 'responses', event_id::VARCHAR, '{"type":"blocked","sub_reason":"' || event_type || '","message":"too ' || event_type || '"}' FROM events WHERE event_id % 10 = 0""",
)
def block_rows(spark, sf_dir):
    refused = table(spark, sf_dir, "events").where("event_id % 10 = 0").selectExpr(
        "event_id AS exchange_id", "'w' AS workspace", "event_type AS event", "concat('too ', event_type) AS reason", "event_type AS sub_reason", "ts")
    rows = captures.block_rows(refused)
    columns = {"audit": ("event", "reason"), "blocks": ("sub_reason", "scrubbed_reason"), "responses": ("exchange_id", "body")}
    out = [rows[p].select(F.lit(p).alias("place"), F.col(a).cast("string").alias("a"), F.col(b).alias("b")) for p, (a, b) in columns.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query("status_row", f"WITH {INBOX_SQL} SELECT count(*) FILTER (s_acctbal >= 0) AS n_ok, count(*) FILTER (s_acctbal < 0) AS n_not_ok, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_blocks, (SELECT count(*) FROM inbox) AS n_open FROM supplier")
def status_row(spark, sf_dir):
    deps = table(spark, sf_dir, "supplier").selectExpr("CASE WHEN s_acctbal >= 0 THEN 'ok' ELSE 'down' END AS state")
    return captures.status(deps, table(spark, sf_dir, "events").where("event_type = 'error'"), inbox(spark, sf_dir))


@_query("declared_collisions", "SELECT c_custkey, 'declared tool name collides with ' || CASE WHEN c_custkey % 2 = 0 THEN 'P' || c_custkey ELSE 'hash:' || substr(sha256(c_name), 1, 12) END AS reason FROM customer")
def declared_collisions(spark, sf_dir):
    """Reasons that name a value by its surrogate, or by a part of its hash where it has none."""
    surrogate = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("P"), "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", captures.declared_collision(F.col("c_name"), surrogate).alias("reason"))


@_query("header_allowlist", "SELECT event_id, 'Accept=' || event_type || ',x-trace=' || user_id AS headers FROM events")
def header_allowlist(spark, sf_dir):
    headers = F.create_map(F.lit("Accept"), F.col("event_type"), F.lit("Cookie"), F.lit("secret"), F.lit("x-trace"), F.col("user_id").cast("string"))
    kept = payloads.kept_headers(headers, ["accept", "X-Trace"])
    listed = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(listed, ",").alias("headers"))


@_query("capture_files", "SELECT user_id, count(*) AS n_records, 'in-flight' AS status FROM events GROUP BY user_id")
def capture_files(spark, sf_dir):
    """Events written as one capture per user, many to a file, then listed."""
    path = new_path(spark, "captures")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_json(F.struct(F.col("event_type").alias("record"), "event_id")).alias("body"))
    files.write_captures(rows, path, "user_id", "event_id", "body")
    lines = files.read_captures(spark, path, packed=True)
    return files.capture_status(lines).select(F.col("file").cast("long").alias("user_id"), "n_records", "status")


@_query("line_clip", "SELECT p_partkey, p_name AS inner_text FROM part")
def line_clip(spark, sf_dir):
    """Spans over three lines are cut to the line of their candidate."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("head\n"), "p_name", F.lit("\ntail")).alias("text"), F.length("p_name").alias("n"))
    cut = passes.clip_to_line(F.col("text"), F.lit(2), F.length("text"), F.lit(5), F.col("n") + 5)
    return rows.select("p_partkey", F.substring("text", cut["s"] + 1, cut["e"] - cut["s"]).alias("inner_text"))


@_query("span_reanchor", "SELECT p_partkey, (length(p_name) + 5)::INT AS s, (2 * length(p_name) + 5)::INT AS e FROM part")
def span_reanchor(spark, sf_dir):
    """The second of two equal names is the one that covers the candidate."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_name", F.lit(" and "), "p_name").alias("context"), F.length("p_name").alias("n"))
    found = passes.reanchor(F.col("context"), F.col("p_name"), F.col("n") + 6, F.col("n") + 7)
    return rows.select("p_partkey", found.alias("f")).select("p_partkey", "f.s", "f.e")


@_query("group_adjudicators", "SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN 'cascade_coalescing' ELSE min(c_mktsegment) END AS adjudicator FROM customer GROUP BY 1")
def group_adjudicators(spark, sf_dir):
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_mktsegment").alias("names"))
    return per.select("c_nationkey", passes.group_adjudicator(F.col("names")).alias("adjudicator"))


@_query("user_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def user_sessions(spark, sf_dir):
    """Activity of each user in sessions that end after half an hour."""
    return views.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@_query("verdict_table", """WITH c AS (SELECT conv_id * 1000 + turn AS hop, sha256(text) AS digest, length(text) > 200 AS long FROM conversations)
SELECT hop, CASE WHEN long THEN '0-' || 5 ELSE '' END AS spans, (SELECT count(DISTINCT digest) FROM c) AS n_asked FROM c""")  # fmt: skip
def verdict_table(spark, sf_dir):
    """Verdicts over all messages, twice: the second run finds all of them in the stored table and asks nothing."""
    hops = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS hop", "text AS context")
    span = F.struct(F.lit(0).alias("s"), F.lit(5).alias("e"))

    def ask(unseen):
        return unseen.withColumn("spans", F.filter(F.array(span), lambda x: F.length("context") > 200))

    none = spark.createDataFrame([], "digest string, spans array<struct<s:int,e:int>>, used long")
    kept = StoredTable.create(none, new_path(spark, "verdicts"), ["digest"])
    kept, _ = verdicts(kept, hops, ask, F.lit(1).cast("long"), most=10**12)
    asked = kept.rows().count()

    def refuse(unseen):
        return unseen.select("digest", F.raise_error(F.lit("a verdict is asked again")).cast("array<struct<s:int,e:int>>").alias("spans"))

    _, found = verdicts(kept, hops, refuse, F.lit(2).cast("long"), most=10**12)
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["s"], x["e"])), ",")
    return found.select("hop", listed.alias("spans"), F.lit(asked).cast("long").alias("n_asked"))

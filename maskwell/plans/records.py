"""Queries on the entity graph, the review inbox, access, audit, traces and captures.

The tables have no such records: customers serve as persons, suppliers as terms, nations as
org units, orders as relationships and events as audit, trace and capture rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.functions.crypto import decrypt, derive_key, encrypt
from maskwell.operators import graph, minting, records
from maskwell.plans.pii import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KEY = derive_key(b"maskwell demonstration root key", "blind-index")
CIPHER_KEY = derive_key(b"maskwell demonstration root key", "cipher")


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    persons = table(spark, sf_dir, "customer").selectExpr(
        "concat('w', c_nationkey) AS workspace", "c_custkey AS entity_id", "'person' AS kind", "c_name AS canonical",
        "array(replace(c_name, '#', ' ')) AS variations", "concat('P', c_custkey) AS surrogate",
    )
    terms = table(spark, sf_dir, "supplier").selectExpr(
        "concat('w', s_nationkey) AS workspace", "1000000000 + s_suppkey AS entity_id", "'term' AS kind", "s_name AS canonical",
        "array(replace(s_name, '#', ' ')) AS variations", "concat('T', s_suppkey) AS surrogate",
    )
    return persons.unionByName(terms)


ENTITIES = """entities AS (
  SELECT 'w' || c_nationkey AS workspace, c_custkey AS entity_id, 'person' AS kind, c_name AS canonical, [replace(c_name, '#', ' ')] AS variations, 'P' || c_custkey AS surrogate FROM customer
  UNION ALL SELECT 'w' || s_nationkey, 1000000000 + s_suppkey, 'term', s_name, [replace(s_name, '#', ' ')], 'T' || s_suppkey FROM supplier)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders tie a customer to the supplier that its key gives, or to another customer."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS source_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'employer' WHEN o_orderkey % 3 = 1 THEN 'subsidiary_of' ELSE 'alias-of' END AS relation",
        "CASE WHEN o_orderkey % 2 = 0 THEN 1000000000 + o_orderkey % 100 ELSE o_orderkey % 50 END AS target_id",
    )


EDGES = """edges AS (SELECT o_custkey AS source_id, CASE o_orderkey % 3 WHEN 0 THEN 'employer' WHEN 1 THEN 'subsidiary_of' ELSE 'alias-of' END AS relation,
  CASE WHEN o_orderkey % 2 = 0 THEN 1000000000 + o_orderkey % 100 ELSE o_orderkey % 50 END AS target_id FROM orders)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer is merged into the one before it."""
    return table(spark, sf_dir, "customer").where("c_custkey % 10 = 1").selectExpr("c_custkey - 1 AS winner_id", "c_custkey AS loser_id")


PAIRS = "pairs AS (SELECT c_custkey - 1 AS winner_id, c_custkey AS loser_id FROM customer WHERE c_custkey % 10 = 1)"


@_query("known_value_union", f"WITH {ENTITIES} SELECT DISTINCT workspace, surface FROM (SELECT workspace, canonical AS surface FROM entities UNION ALL SELECT workspace, unnest(variations) FROM entities)")
def known_value_union(spark, sf_dir):
    return graph.surfaces(entities(spark, sf_dir)).select("workspace", "surface").distinct()


@_query("merge_entities", f"""WITH {ENTITIES}, {PAIRS}, gain AS (SELECT winner_id, [canonical, variations[1]] AS more FROM entities JOIN pairs ON entity_id = loser_id)
SELECT entity_id, canonical, array_to_string(list_concat(variations, coalesce(more, [])), '|') AS variations FROM entities LEFT JOIN gain ON entity_id = winner_id
WHERE entity_id NOT IN (SELECT loser_id FROM pairs)""")  # fmt: skip
def merge_entities(spark, sf_dir):
    merged = graph.merge(entities(spark, sf_dir), pairs(spark, sf_dir))
    return merged.select("entity_id", "canonical", F.array_join("variations", "|").alias("variations"))


@_query("merge_rehome_edges", f"""WITH {EDGES}, {PAIRS} SELECT DISTINCT coalesce(a.winner_id, source_id) AS source_id, relation, coalesce(b.winner_id, target_id) AS target_id
FROM edges LEFT JOIN pairs a ON a.loser_id = source_id LEFT JOIN pairs b ON b.loser_id = target_id WHERE coalesce(a.winner_id, source_id) <> coalesce(b.winner_id, target_id)""")  # fmt: skip
def merge_rehome_edges(spark, sf_dir):
    return graph.rehome(edges(spark, sf_dir), pairs(spark, sf_dir), ["source_id", "target_id"])


@_query("edge_summaries", f"""WITH {ENTITIES}, {EDGES}, o AS (SELECT source_id, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT target_id, count(*) AS n, count(DISTINCT source_id) AS d FROM edges WHERE source_id <> target_id GROUP BY 1)
SELECT entity_id, surrogate, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in, coalesce(i.d, 0) AS n_dependents FROM entities LEFT JOIN o ON o.source_id = entity_id LEFT JOIN i ON i.target_id = entity_id""")  # fmt: skip
def edge_summaries(spark, sf_dir):
    return graph.edge_summaries(entities(spark, sf_dir), edges(spark, sf_dir))


@_query("dependents_count", f"WITH {EDGES} SELECT target_id, count(DISTINCT source_id) AS n_dependents FROM edges WHERE source_id <> target_id GROUP BY target_id")
def dependents_count(spark, sf_dir):
    return edges(spark, sf_dir).where("source_id <> target_id").groupBy("target_id").agg(F.countDistinct("source_id").alias("n_dependents"))


@_query("neighbour_lookup", f"WITH {EDGES} SELECT * FROM edges WHERE source_id = 7 OR target_id = 7")
def neighbour_lookup(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), F.lit(7))


@_query("seed_preview_problems", f"""WITH {ENTITIES}, {EDGES} SELECT source_id, relation, target_id, CASE WHEN relation NOT IN ('employer', 'subsidiary_of') THEN 'unknown_relation'
  WHEN coalesce((relation = 'employer' AND s.kind = 'person' AND t.kind = 'term') OR (relation = 'subsidiary_of' AND s.kind = 'term' AND t.kind = 'term'), false) THEN '' ELSE 'orientation_violation' END AS problems
FROM edges LEFT JOIN entities s ON s.entity_id = source_id LEFT JOIN entities t ON t.entity_id = target_id""")  # fmt: skip
def seed_preview_problems(spark, sf_dir):
    checked = graph.edge_problems(edges(spark, sf_dir), entities(spark, sf_dir).select("entity_id", "kind"))
    return checked.select("source_id", "relation", "target_id", F.array_join("problems", ",").alias("problems"))


@_query("org_graph_edges", """SELECT 'N' || n_nationkey AS unit, 'R' || n_regionkey AS ancestor, 1 AS distance FROM nation
UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 1 FROM customer UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey""")  # fmt: skip
def org_graph_edges(spark, sf_dir):
    """Customers under nations under regions, with the distance to every unit above."""
    units = table(spark, sf_dir, "nation").selectExpr("concat('N', n_nationkey) AS unit", "concat('R', n_regionkey) AS parent")
    units = units.unionByName(table(spark, sf_dir, "customer").selectExpr("concat('C', c_custkey) AS unit", "concat('N', c_nationkey) AS parent"))
    units = units.unionByName(table(spark, sf_dir, "region").selectExpr("concat('R', r_regionkey) AS unit", "cast(NULL AS string) AS parent"))
    return graph.org_path(units, 2)


@_query("real_name_search_blind_index", f"WITH {ENTITIES} SELECT entity_id, surface FROM (SELECT entity_id, canonical AS surface FROM entities UNION ALL SELECT entity_id, unnest(variations) FROM entities) WHERE surface = 'Customer 000000042'")
def real_name_search_blind_index(spark, sf_dir):
    index = graph.with_blind_index(graph.surfaces(entities(spark, sf_dir)), "surface", KEY)
    return graph.search(index, "Customer 000000042", KEY).select("entity_id", "surface")


@_query("surrogate_space_search", f"WITH {ENTITIES} SELECT entity_id, surrogate FROM entities WHERE lower(surrogate) LIKE '%p10%'")
def surrogate_space_search(spark, sf_dir):
    return entities(spark, sf_dir).where(F.lower("surrogate").contains("p10")).select("entity_id", "surrogate")


@_query("blind_index_hmac", None)
def blind_index_hmac(spark, sf_dir):
    """HMAC of every name; tested against the standard library."""
    return graph.with_blind_index(entities(spark, sf_dir).select("entity_id", "canonical"), "canonical", KEY)


@_query("cipher_round_trip", f"WITH {ENTITIES} SELECT entity_id, canonical AS plain, true AS has_prefix, true AS bound FROM entities")
def cipher_round_trip(spark, sf_dir):
    """Names encrypted and decrypted; another workspace does not decrypt them."""
    stored = entities(spark, sf_dir).withColumn("cell", encrypt(F.col("canonical"), CIPHER_KEY, F.col("workspace")))
    other = decrypt(F.col("cell"), CIPHER_KEY, F.concat("workspace", F.lit("x")))
    return stored.select("entity_id", decrypt(F.col("cell"), CIPHER_KEY, F.col("workspace")).alias("plain"), F.col("cell").startswith("bf:v1:").alias("has_prefix"), other.isNull().alias("bound"))


@_query("surrogate_edit_conflicts", f"WITH {ENTITIES} SELECT workspace, entity_id, 'P' || (entity_id + 25) AS surrogate FROM entities e WHERE kind = 'person' AND EXISTS (SELECT 1 FROM entities o WHERE o.workspace = e.workspace AND o.surrogate = 'P' || (e.entity_id + 25))")
def surrogate_edit_conflicts(spark, sf_dir):
    all_entities = entities(spark, sf_dir)
    edits = all_entities.where("kind = 'person'").selectExpr("workspace", "entity_id", "concat('P', entity_id + 25) AS surrogate")
    return graph.edit_conflicts(edits, all_entities.select("workspace", "entity_id", "surrogate", F.lit(True).alias("active")))


@_query("role_assignments", "SELECT DISTINCT c_nationkey AS workspace, c_custkey AS person_id, c_mktsegment AS role FROM customer")
def role_assignments(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS workspace", "c_custkey AS person_id", "c_mktsegment AS role")
    return rows.unionByName(rows).dropDuplicates()


LEGAL = "CASE o_orderkey % 4 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' GmbH & Co. KG' WHEN 2 THEN ' Inc.' ELSE '' END"


@_query("legal_form_variations", f"SELECT o_orderkey, o_orderpriority || {LEGAL} AS name, o_orderpriority AS referent, CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 2 END AS n_variations FROM orders")
def legal_form_variations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"concat(o_orderpriority, {LEGAL}) AS name")
    kind = F.lit("organization")
    return rows.select("o_orderkey", "name", minting.referent_key(F.col("name"), kind).alias("referent"), F.size(minting.variations(F.col("name"), kind)).alias("n_variations"))


@_query("inbox_first_occurrence", f"""WITH c AS (SELECT o_orderkey, p_name || {LEGAL} AS value, p_name AS referent FROM orders JOIN part ON p_partkey = o_orderkey % 200),
f AS (SELECT referent, arg_min(value, o_orderkey) AS value, min(o_orderkey) AS o_orderkey FROM c GROUP BY referent)
SELECT referent, value, o_orderkey, row_number() OVER (ORDER BY o_orderkey, referent) AS item_id FROM f""")  # fmt: skip
def inbox_first_occurrence(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = table(spark, sf_dir, "orders").withColumn("p_partkey", F.col("o_orderkey") % 200)
    rows = orders.join(parts, "p_partkey").selectExpr("o_orderkey", f"concat(p_name, {LEGAL}) AS value", "'organization' AS entity_type")
    return minting.inbox(rows, ["o_orderkey"]).select("referent", "value", "o_orderkey", "item_id")


@_query("provisional_rank_mint", """WITH pool AS (SELECT kind, entry, row_number() OVER (PARTITION BY kind ORDER BY pos) - 1 AS ordinal FROM (VALUES ('term', 0, 'red moon'), ('term', 1, 'Projekt Auenthal'), ('term', 2, 'Vorgang Birkenau')) p(kind, pos, entry) WHERE entry <> 'red moon'),
names AS (SELECT DISTINCT p_name AS value FROM part), n AS (SELECT 'term' AS kind, value, row_number() OVER (ORDER BY value) - 1 AS ordinal FROM names)
SELECT value, ordinal, coalesce(entry, 'BFT' || printf('%04d', ordinal - 2)) AS surrogate FROM n LEFT JOIN pool USING (kind, ordinal)""")  # fmt: skip
def provisional_rank_mint(spark, sf_dir):
    """Names of parts get pool entries that share no word with a known name, then numbered ones."""
    names = table(spark, sf_dir, "part").select(F.lit("term").alias("kind"), F.col("p_name").alias("value")).distinct()
    pool = minting.pool_table(spark, {"term": ["red moon", "Projekt Auenthal", "Vorgang Birkenau"]})
    return minting.mint_names(names, pool, names.select("value"), ["value"]).select("value", "ordinal", "surrogate")


@_query("component_map", """WITH p AS (SELECT DISTINCT p_name AS value, upper(split_part(p_name, ' ', 1)) || ' ' || CASE WHEN p_partkey % 50 = 0 THEN 'other' ELSE upper(split_part(p_name, ' ', 2)) END AS surrogate FROM part), z AS (SELECT unnest(string_split(value, ' ')) AS word, unnest(string_split(surrogate, ' ')) AS target FROM p
  WHERE len(string_split(value, ' ')) = len(string_split(surrogate, ' ')) AND len(string_split(value, ' ')) >= 2)
SELECT word, min(target) AS target FROM z GROUP BY word HAVING count(DISTINCT target) = 1""")  # fmt: skip
def component_map(spark, sf_dir):
    items = table(spark, sf_dir, "part").selectExpr(
        "p_name AS value",
        "concat(upper(split_part(p_name, ' ', 1)), ' ', CASE WHEN p_partkey % 50 = 0 THEN 'other' ELSE upper(split_part(p_name, ' ', 2)) END) AS surrogate",
    ).distinct()
    return minting.component_map(items)


@_query("surrogate_collision_purge", """SELECT p_partkey, p_name AS value FROM part WHERE p_name NOT IN (SELECT unnest(list_append(string_split(p_name, ' '), p_name)) FROM part WHERE p_partkey = 0)""")
def surrogate_collision_purge(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    live = parts.where("p_partkey = 0").select(F.col("p_name").alias("surrogate"))
    return minting.purge_collisions(parts.selectExpr("p_partkey", "p_name AS value"), live)


@_query("rbac_visible_workspaces", "SELECT 'w' || o_custkey % 5 AS workspace, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS roles FROM orders WHERE o_custkey = 7 GROUP BY 1")
def rbac_visible_workspaces(spark, sf_dir):
    grants = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey AS string) AS identity", "concat('w', o_custkey % 5) AS workspace", "o_orderstatus AS role")
    names = table(spark, sf_dir, "region").selectExpr("concat('w', r_regionkey) AS workspace")
    return records.visible_workspaces(grants, names, F.lit("7"))


@_query("rbac_role_filter", "SELECT event_id, 'u' || user_id AS identity FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def rbac_role_filter(spark, sf_dir):
    grants = table(spark, sf_dir, "orders").selectExpr("concat('u', o_custkey) AS identity", "'w' AS workspace", "o_orderstatus AS role")
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "concat('u', user_id) AS identity", "'w' AS workspace")
    return records.has_role(rows, grants, "F").select("event_id", "identity")


@_query("policy_defaults", "SELECT 'w' || n_nationkey AS workspace, n_nationkey < 5 AS deterministic_only, NOT (n_nationkey < 5 AND n_nationkey % 2 = 0) AS phone_candidates_enabled, n_nationkey >= 5 AS fail_closed FROM nation")
def policy_defaults(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    settings = nations.where("n_nationkey < 5").selectExpr("concat('w', n_nationkey) AS workspace", "true AS deterministic_only", "n_nationkey % 2 <> 0 AS phone_candidates_enabled")
    return records.policies(nations.selectExpr("concat('w', n_nationkey) AS workspace"), settings)


@_query("reidentify_audit", f"""WITH {ENTITIES} SELECT entity_id, CASE WHEN entity_id % 3 = 0 AND entity_id % 2 = 0 THEN canonical END AS real,
  CASE WHEN entity_id % 3 <> 0 THEN 're-identify-denied' WHEN entity_id % 2 <> 0 THEN 're-identify-failed' ELSE 're-identified' END AS event FROM entities""")  # fmt: skip
def reidentify_audit(spark, sf_dir):
    all_entities = entities(spark, sf_dir)
    requests = all_entities.selectExpr("entity_id", "concat('u', entity_id) AS identity", "workspace", "surrogate")
    grants = requests.where("entity_id % 3 = 0").selectExpr("identity", "workspace", "'re-identify' AS role")
    store = all_entities.where("entity_id % 2 = 0").select("workspace", "surrogate", encrypt(F.col("canonical"), CIPHER_KEY, F.col("workspace")).alias("ciphertext"))
    return records.reidentify(requests, grants, store, CIPHER_KEY).select("entity_id", "real", "event")


AUDIT = "CASE event_type WHEN 'error' THEN 'blocked-leak' WHEN 'click' THEN 're-identified' WHEN 'view' THEN 'entity-list-searched' ELSE event_type END"


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "concat('u', user_id) AS identity", f"{AUDIT} AS event", "concat('w', user_id % 4) AS workspace")


@_query("audit_kind_filter", f"""SELECT event_id, identity, event, kind FROM (SELECT event_id, ts, 'u' || user_id AS identity, {AUDIT} AS event, user_id % 4 AS w,
  CASE event_type WHEN 'error' THEN 'block' WHEN 'click' THEN 'reveal' WHEN 'view' THEN 'lookup' END AS kind FROM events) WHERE w = 1 AND kind = 'block' AND ts >= TIMESTAMP '2024-01-05 00:00:00'""")  # fmt: skip
def audit_kind_filter(spark, sf_dir):
    rows = records.audit(audit_log(spark, sf_dir), F.lit("w1"), "block", since=F.expr("TIMESTAMP '2024-01-05 00:00:00'"))
    return rows.select("event_id", "identity", "event", "kind")


@_query("audit_actors", "SELECT DISTINCT 'u' || user_id AS identity FROM events WHERE event_type IN ('error', 'click', 'view')")
def audit_actors(spark, sf_dir):
    return records.audit(audit_log(spark, sf_dir)).where("kind is not null").select("identity").distinct()


@_query("recent_blocks_15min", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE")
def recent_blocks_15min(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    now = rows.agg(F.max("ts").alias("now"))
    return records.recent(rows.crossJoin(F.broadcast(now)), F.col("now")).select("event_id")  # one row


@_query("rolling_blocks", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS n_recent FROM events WHERE event_type = 'error'")
def rolling_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    return records.rolling_count(rows, "user_id", 900).select("event_id", "n_recent")


@_query("trace_ring_200", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 200")
def trace_ring_200(spark, sf_dir):
    return records.last_per_key(table(spark, sf_dir, "events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type")


@_query("consecutive_failure_health", """WITH r AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
c AS (SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM r) SELECT event_id, failures, failures < 3 AS healthy FROM c""")  # fmt: skip
def consecutive_failure_health(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return records.failure_runs(rows, "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "failures", "healthy")


@_query("ttl_probe", """WITH RECURSIVE t AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
p AS (SELECT user_id, ts AS probed_at FROM t WHERE n = 1 UNION ALL
  SELECT user_id, nxt FROM (SELECT p.user_id, (SELECT min(t.ts) FROM t WHERE t.user_id = p.user_id AND t.ts >= p.probed_at + INTERVAL 3600 SECOND) AS nxt FROM p) WHERE nxt IS NOT NULL)
SELECT user_id, probed_at FROM p""")  # fmt: skip
def ttl_probe(spark, sf_dir):
    """Requests an hour or more after the last probe of their user."""
    return records.probes(table(spark, sf_dir, "events"), "user_id", 3600)


@_query("unprotected_interval_join", """SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'purchase' AND o.user_id = e.user_id AND e.ts >= o.ts AND e.ts < o.ts + INTERVAL 15 MINUTE)""")
def unprotected_interval_join(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    overrides = rows.where("event_type = 'purchase'").selectExpr("user_id", "ts AS start", "ts + INTERVAL 15 MINUTES AS end")
    return records.overridden(rows, overrides, "user_id").select("event_id")


@_query("capture_retention_topk", """WITH idle AS (SELECT event_id AS capture_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type <> 'error')
SELECT capture_id FROM idle WHERE n <= (SELECT greatest(count(*) - 200, 0) FROM events)""")  # fmt: skip
def capture_retention_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return records.evictable(rows.selectExpr("event_id AS capture_id"), rows.where("event_type = 'error'").selectExpr("event_id AS capture_id"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "events").selectExpr(
        "user_id AS capture_id",
        "CASE WHEN event_id % 5 = 0 THEN concat('ID-RESERVED-', event_id) ELSE concat('S', event_id) END AS surrogate",
        "CASE WHEN event_id % 3 = 0 THEN concat('Customer#', lpad(event_id % 3000, 9, '0')) END AS real",
        "event_id",
    )
    return base.where("event_id % 7 <> 0").drop("event_id"), base.where("event_id % 11 <> 0").drop("event_id")


@_query("capture_compare_severity", """WITH b AS (SELECT user_id AS capture_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'ID-RESERVED-' || event_id ELSE 'S' || event_id END AS surrogate,
  CASE WHEN event_id % 3 = 0 THEN 'Customer#' || lpad((event_id % 3000)::VARCHAR, 9, '0') END AS real FROM events)
SELECT capture_id, surrogate, CASE WHEN event_id % 7 <> 0 THEN 'observed' ELSE 'reconstructed' END AS side,
  CASE WHEN real IN (SELECT c_name FROM customer) THEN 'defect' WHEN real IS NOT NULL THEN 'expected' WHEN event_id % 5 = 0 THEN 'expected' ELSE 'unknown' END AS severity
FROM b WHERE (event_id % 7 = 0) <> (event_id % 11 = 0)
  AND capture_id IN (SELECT capture_id FROM b WHERE event_id % 11 <> 0)""")  # fmt: skip
def capture_compare_severity(spark, sf_dir):
    observed, reconstructed = _sides(spark, sf_dir)
    return records.compare(observed, reconstructed, table(spark, sf_dir, "customer").selectExpr("c_name AS real"))


@_query("surrogate_lifecycle", """SELECT p_partkey, 'S' || p_partkey AS surrogate, CASE WHEN p_partkey % 3 = 0 THEN 'pending' WHEN p_partkey % 5 = 0 THEN 'confirmed' ELSE 'rejected' END AS state FROM part""")
def surrogate_lifecycle(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('S', p_partkey) AS surrogate")
    return records.lifecycle(rows, rows.where("p_partkey % 3 = 0"), rows.where("p_partkey % 5 = 0"))


@_query("trace_rollup", """SELECT user_id, arg_min(provider, event_id) FILTER (provider IS NOT NULL) AS provider, sum(event_id % 17) AS duration_ms, count(*) AS n_hops, sum(event_id % 4) AS detected, arg_max(event_type, event_id) AS outcome
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN event_type END AS provider FROM events) GROUP BY user_id""")  # fmt: skip
def trace_rollup(spark, sf_dir):
    hops = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id AS hop_index", "CASE WHEN event_id % 2 = 0 THEN event_type END AS provider",
        "event_id % 17 AS duration_ms", "event_id % 4 AS detected", "event_type AS outcome",
    )
    return records.trace_roll_up(hops, "user_id")


@_query("upstream_error_mapping", """SELECT event_id, CASE WHEN event_type = 'view' THEN 504 ELSE 502 END AS status, CASE WHEN event_type = 'view' THEN 'timeout' WHEN event_type = 'error' THEN 'http_status' ELSE 'connection' END AS sub_reason FROM events""")
def upstream_error_mapping(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_type = 'error' THEN 500 END AS code", "CASE WHEN event_type = 'view' THEN 'timeout' END AS class")
    return rows.select("event_id", records.upstream_error(F.col("code"), F.col("class")).alias("m")).select("event_id", "m.*")


@_query("dependency_state", "SELECT user_id, CASE WHEN bool_and(value < 190) THEN 'protected' ELSE 'degraded' END AS state FROM events GROUP BY user_id")
def dependency_state(spark, sf_dir):
    return records.dependency_state(table(spark, sf_dir, "events"), "user_id", F.col("value") < 190)


@_query("leak_check_summary", """WITH known AS (SELECT DISTINCT c_name AS real FROM customer), out AS (SELECT event_id, 'sent Customer#' || lpad((event_id % 2500)::VARCHAR, 9, '0') AS body FROM events)
SELECT real, count(*) AS n_records, 'hash:' || substr(sha256(real), 1, 12) AS ref FROM known JOIN out ON substr(body, 6) = real GROUP BY real""")  # fmt: skip
def leak_check_summary(spark, sf_dir):
    """Known names in outgoing records, reported by hash."""
    known = table(spark, sf_dir, "customer").selectExpr("c_name AS real").distinct()
    out = table(spark, sf_dir, "events").selectExpr("event_id", "concat('sent Customer#', lpad(event_id % 2500, 9, '0')) AS body")
    pieces = out.select("event_id", F.explode(F.regexp_extract_all("body", F.lit("Customer#[0-9]+"), F.lit(0))).alias("real"))
    found = pieces.distinct().join(known, "real").groupBy("real").agg(F.count("*").alias("n_records"))
    return found.select("real", "n_records", words.scrubbed(F.col("real"), F.lit(None).cast("string")).alias("ref"))

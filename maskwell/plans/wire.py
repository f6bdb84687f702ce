"""Queries on request payloads, captures and streams, composed from conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators import rewrite
from maskwell.operators.stored import StoredTable
from maskwell.plans.pii import BEYOND, KINDS, table, texts
from maskwell.shared import new_path
from maskwell.sources import files, payloads
from maskwell.streaming import ordered, restore, views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON request per conversation: odd ones with lists of blocks, every third with a system field."""
    turns = table(spark, sf_dir, "conversations")
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    listed = F.to_json(F.struct("role", F.array(block).alias("content")))
    message = F.when(F.col("conv_id") % 2 == 1, listed).otherwise(plain)
    per = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    body = F.concat(F.lit('"messages":['), F.array_join(F.col("ms.m"), ","), F.lit("]}"))
    head = F.when(F.col("conv_id") % 3 == 0, F.lit('{"system":"be brief",')).otherwise(F.lit("{"))
    return per.select(F.col("conv_id").alias("exchange_id"), F.concat(head, body).alias("payload"))


@_query(
    "dialect_detection",
    "SELECT conv_id AS exchange_id, CASE WHEN conv_id % 3 = 0 THEN 'messages' WHEN bool_or(role = 'system') THEN 'chat' ELSE 'messages' END AS dialect FROM conversations GROUP BY conv_id",
)
def dialect_detection(spark, sf_dir):
    return requests(spark, sf_dir).select("exchange_id", payloads.dialect(F.col("payload")).alias("dialect"))


_HOPS = "SELECT conv_id AS exchange_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS hop_index, role, text FROM conversations"


@_query("hop_projection", f"SELECT exchange_id, hop_index, role, CASE WHEN role = 'tool' THEN 'tool_result' ELSE role END AS hop_kind, text FROM ({_HOPS})")
def hop_projection(spark, sf_dir):
    return payloads.hops(requests(spark, sf_dir))


@_query("hop_kind_counts", f"SELECT role AS hop_kind, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM ({_HOPS}) GROUP BY role")
def hop_kind_counts(spark, sf_dir):
    found = payloads.hops(requests(spark, sf_dir))
    return found.groupBy("hop_kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@_query(
    "first_user_excerpt",
    r"""SELECT exchange_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS excerpt FROM (
  SELECT conv_id AS exchange_id, arg_min(trim(regexp_replace(text, '\s+', ' ', 'g')), turn) AS t FROM conversations
  WHERE role = 'user' AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' GROUP BY conv_id)""",
)
def first_user_excerpt(spark, sf_dir):
    return payloads.first_user_excerpt(payloads.hops(requests(spark, sf_dir)))


@_query("payload_leaf_counts", "SELECT conv_id AS exchange_id, count(*) * CASE WHEN conv_id % 2 = 1 THEN 3 ELSE 2 END + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS n_leaves FROM conversations GROUP BY conv_id")
def payload_leaf_counts(spark, sf_dir):
    return payloads.leaves(requests(spark, sf_dir)).groupBy("exchange_id").agg(F.count("*").alias("n_leaves"))


@_query("nul_joined_text", "SELECT conv_id AS exchange_id, sha256(string_agg(text, chr(0) ORDER BY turn)) AS joined_sha256 FROM conversations GROUP BY conv_id")
def nul_joined_text(spark, sf_dir):
    """Message texts only, joined by NUL, as a digest."""
    found = payloads.leaves(requests(spark, sf_dir)).where(F.col("path").rlike(r"\.(content|text)$"))
    return payloads.joined_text(found).select("exchange_id", F.sha2("text", 256).alias("joined_sha256"))


@_query("props_json_extract", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def props_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query("capture_size_cap", """WITH s AS (SELECT user_id, event_id, event_type, sum(length(event_type) + 1) OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM events),
f AS (SELECT *, min(event_id) FILTER (upto > 300) OVER (PARTITION BY user_id) AS first FROM s)
SELECT user_id, event_id, CASE WHEN upto > 300 THEN '{"record":"truncated","reason":"size cap"}' ELSE event_type END AS body FROM f WHERE upto <= 300 OR event_id = first""")  # fmt: skip
def capture_size_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type AS body")
    return files.capped(rows, "user_id", "event_id", "body", limit=300)


@_query("store_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part")
def store_upsert(spark, sf_dir):
    """A stored table after an upsert, opened anew, and after the same upsert again."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    updates = rows.where("p_partkey % 4 = 0").selectExpr("p_partkey", "upper(p_name) AS p_name", "1 AS seq")
    stale = updates.selectExpr("p_partkey", "'old' AS p_name", "0 AS seq")
    parts = StoredTable.create(rows, new_path(spark, "parts"), ["p_partkey"])
    parts.upserted(updates.unionByName(stale), order="seq")
    return StoredTable.open(spark, parts.path).upserted(updates, order="seq").rows()


def blinded_chunks(spark: SparkSession, sf_dir: str, size: int = 400) -> DataFrame:
    """Blinded documents in chunks of ``size`` characters, each with the session of its document."""
    docs = texts(spark, sf_dir)
    located, _ = rewrite.contact_data(docs, "doc_id", KINDS, BEYOND)
    session = rewrite.session_of(docs, "doc_id", located)
    session = session.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("surrogate", "real")))).alias("session"))
    blinded = rewrite.blind(docs, "doc_id", located).join(session, "doc_id", "left")
    n = F.greatest(F.lit(1), F.ceil(F.length("blinded") / size)).cast("int")
    parts = blinded.select("doc_id", "blinded", "session", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return parts.select(
        F.col("doc_id").alias("exchange_id"),
        F.col("k").cast("long").alias("seq"),
        F.substring("blinded", F.col("k") * size + 1, F.lit(size)).alias("chunk"),
        (F.col("k") == F.col("n") - 1).alias("last"),
        F.coalesce("session", F.lit("{}")).alias("session"),
    )


@_query("stream_chunk_restore_batch", "SELECT doc_id AS exchange_id, text FROM documents")
def stream_chunk_restore_batch(spark, sf_dir):
    """Chunks put together, then restored."""
    chunks = blinded_chunks(spark, sf_dir)
    whole = restore.reassemble(chunks.withColumnRenamed("chunk", "piece"))
    session = chunks.where("seq = 0").select("exchange_id", F.from_json("session", "map<string,string>").alias("back"))
    joined = whole.join(session, "exchange_id")
    return joined.select("exchange_id", F.when(F.size("back") == 0, F.col("text")).otherwise(rewrite.restored(F.col("text"), F.col("back"))).alias("text"))


@_query("stream_chunk_restore", "SELECT doc_id AS exchange_id, text FROM documents")
def stream_chunk_restore(spark, sf_dir):
    """The same by a stream with state: the chunks arrive as files, the pieces are put together."""
    source, out = new_path(spark, "chunks"), new_path(spark, "pieces")
    chunks = blinded_chunks(spark, sf_dir)
    chunks.write.parquet(source)
    stream = spark.readStream.schema(chunks.schema).parquet(source)
    ordered.start(restore.restore_stream(stream), out).awaitTermination()
    return restore.reassemble(spark.read.schema(restore.OUTPUT).parquet(out))


@_query("blocks_per_window", "SELECT to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def blocks_per_window(spark, sf_dir):
    """The streaming view run over the table at rest."""
    rows = views.blocks_per_window(table(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_LATE = "event_id % 50 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@_query(
    "blocks_per_window_stream",
    f"""WITH kept AS (SELECT * FROM events WHERE NOT ({_LATE})),
w AS (SELECT to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS start, event_type, count(*) AS n FROM kept GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM kept) - INTERVAL 10 MINUTE""",
)
def blocks_per_window_stream(spark, sf_dir):
    """The same view as a stream that is stopped and restarted twice; rows that come a day late are dropped.

    A window is final, and written, once the watermark has passed its end.
    """
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    span = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    late = (F.col("event_id") % 50 == 0) & (F.col("ts") < F.lit(span.high) - F.expr("INTERVAL 1 DAY"))
    early = F.col("ts") < F.lit(span.low + (span.high - span.low) / 2)
    source, out, state = new_path(spark, "events"), new_path(spark, "windows"), new_path(spark, "windows-state")
    for part in (rows.where(~late & early), rows.where(~late & ~early), rows.where(late)):
        part.write.mode("append").parquet(source)
        stream = views.blocks_per_window(spark.readStream.schema(rows.schema).parquet(source))
        ordered.start(stream, out, state).awaitTermination()
    written = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out)
    return written.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@_query("tool_vocabulary", "SELECT DISTINCT p_size AS workspace, word FROM (SELECT p_size, unnest(list_concat([p_brand || '_' || p_name], regexp_split_to_array(p_brand || '_' || p_name, '[_.\\-]+'))) AS word FROM part) WHERE word <> ''")
def tool_vocabulary(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_size AS workspace", "concat(p_brand, '_', p_name) AS tool")
    return views.tool_vocabulary(rows)



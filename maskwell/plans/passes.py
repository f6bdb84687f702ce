"""Queries on the whole pass: texts, payloads, answers and streams, blinded and restored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions import words
from maskwell.operators import candidates, detect, minting, passes, rewrite
from maskwell.operators.ordinal import with_ordinal
from maskwell.plans import language, pii
from maskwell.plans.pii import BEYOND, KINDS, table, texts
from maskwell.plans.wire import requests
from maskwell.shared import materialize, new_path, path_of, release
from maskwell.sources import payloads
from maskwell.streaming import events, ordered

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


W = words.WORD
# Entities of the dictionary get a name by number; open items are pairs of longer words of the benchmark texts.
SURROGATES_SQL = """surrogates AS (SELECT entity, 'Werk ' || entity AS surrogate, arg_min(surface, ord) AS canonical FROM dict GROUP BY entity)"""
ITEMS_SQL = f"""items AS (SELECT item_id, w[5] || ' ' || w[6] AS value, 'Vor' || item_id || ' Nach' || item_id AS surrogate
  FROM (SELECT item_id, regexp_extract_all(text, '{W}') AS w FROM benchmark) WHERE length(w[5]) >= 5 AND length(w[6]) >= 5),
parts AS (SELECT item_id, unnest(string_split(value, ' ')) AS word, unnest(string_split(surrogate, ' ')) AS target FROM items),
single AS (SELECT word, min(target) AS target FROM parts WHERE lower(word) NOT IN ({language._in(STOP)}) GROUP BY word HAVING count(DISTINCT target) = 1),
pairs AS (SELECT item_id, value, surrogate, value AS real FROM items
  UNION ALL SELECT DISTINCT item_id, word, s.target, word FROM parts p JOIN single s USING (word))"""


def choice_sql(key: str) -> str:
    """Spans of ``every`` chosen by precedence: ``chosen``."""
    return f"""ranked AS (SELECT {key}, list({{'s': s, 'e': e, 'layer': layer, 'surrogate': surrogate, 'real': real}} ORDER BY layer, rank, s - e, s) AS m FROM every GROUP BY {key}),
settled AS (SELECT {key}, list_reduce(list_transform(m, lambda x: [x]), lambda acc, y:
  CASE WHEN list_bool_or(list_transform(acc, lambda k: k.s < y[1].e AND y[1].s < k.e)) THEN acc ELSE list_concat(acc, y) END) AS m FROM ranked),
chosen AS (SELECT {key}, x.s AS s, x.e AS e, ['dictionary', 'pair', 'contact'][x.layer + 1] AS layer, x.surrogate AS surrogate, x.real AS real FROM (SELECT {key}, unnest(m) AS x FROM settled))"""


def all_spans_sql(source: str = "documents", key: str = "doc_id", contact: bool = True) -> str:
    """Spans of all layers, chosen by precedence: ``chosen``."""
    named = f"UNION ALL SELECT {key}, s, e, 2, 0, surrogate, value FROM found JOIN named USING (kind, value)" if contact else ""
    return f"""{language.l2_sql(source, key)}, {language.kept_sql(key)}, {SURROGATES_SQL}, {ITEMS_SQL},
every AS (SELECT {key}, s, e, 0 AS layer, 0 AS rank, surrogate, canonical AS real FROM l2 JOIN surrogates USING (entity)
  UNION ALL SELECT w.{key}, w.s, w.e, 1, p.item_id, p.surrogate, p.real FROM wins w JOIN pairs p ON w.phrase = p.value AND w.e - w.s = length(p.value)
  {named}),
{choice_sql(key)}"""


DOCS_SQL = f"{pii.FOUND}, {pii.MINTED}, {all_spans_sql()}"
BLIND_SQL = f"{DOCS_SQL}, located AS (SELECT * FROM chosen), {pii.WOVEN}"


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dictionary, surrogates of its entities and open items, all from the benchmark texts."""
    names = language.benchmark_dictionary(spark, sf_dir)
    surrogates = names.groupBy("entity").agg(F.min_by("surface", "ord").alias("canonical"))
    surrogates = surrogates.withColumn("surrogate", F.concat(F.lit("Werk "), F.col("entity")))
    w = words.words(F.col("text"))
    two = F.slice(w, 5, 2)
    items = table(spark, sf_dir, "benchmark").select("item_id", two.alias("w")).where("size(w) = 2 AND length(w[0]) >= 5 AND length(w[1]) >= 5")
    items = items.selectExpr("item_id", "concat_ws(' ', w) AS value", "'person' AS entity_type", "concat('Vor', item_id, ' Nach', item_id) AS surrogate")
    return names, surrogates, items


def chosen_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chosen, minted = passes.deterministic_spans(texts(spark, sf_dir), "doc_id", *_names(spark, sf_dir), STOP, KINDS, BEYOND)
    return materialize(chosen, "chosen"), minted


@_query("detection_pass", f"WITH {BLIND_SQL} SELECT doc_id, n_spans, blinded FROM blinded")
def detection_pass(spark, sf_dir):
    """Dictionary names, open items and contact data of all documents in one splice."""
    chosen, _ = chosen_spans(spark, sf_dir)
    return passes.blind_texts(texts(spark, sf_dir), "doc_id", chosen).drop("text")


@_query("pass_spans", f"WITH {DOCS_SQL} SELECT * FROM chosen")
def pass_spans(spark, sf_dir):
    return chosen_spans(spark, sf_dir)[0]


@_query(
    "hop_details",
    f"""WITH {DOCS_SQL} SELECT doc_id, count(*) FILTER (layer = 'dictionary') AS n_dictionary, count(*) FILTER (layer = 'pair') AS n_pair,
  count(DISTINCT real) FILTER (layer = 'contact') AS n_contact, list_aggregate(list_sort(list(DISTINCT surrogate)), 'string_agg', ',') AS surrogates FROM chosen GROUP BY doc_id""",
)
def hop_details(spark, sf_dir):
    return passes.hop_details(chosen_spans(spark, sf_dir)[0], "doc_id")


@_query("pass_sessions", f"WITH {DOCS_SQL} SELECT doc_id, surrogate, arg_max(real, s) AS real FROM chosen GROUP BY ALL")
def pass_sessions(spark, sf_dir):
    """What each document's exchange records: of repeated surrogates the last real value."""
    session = passes.session_of(chosen_spans(spark, sf_dir)[0], "doc_id")
    return session.groupBy("doc_id", "surrogate").agg(F.max_by("real", "seq").alias("real"))


@_query(
    "pass_gate",
    f"""WITH {BLIND_SQL}, known AS (SELECT surface AS value FROM dict UNION SELECT value FROM pairs UNION SELECT value FROM named),
standing AS MATERIALIZED (SELECT doc_id, value, blinded FROM blinded JOIN known ON contains(blinded, value))
SELECT doc_id, value FROM standing WHERE regexp_matches(blinded, {pii._WHOLE})""",
)
def pass_gate(spark, sf_dir):
    """Values of any layer that still stand in a blinded document."""
    names, _, items = _names(spark, sf_dir)
    chosen, minted = chosen_spans(spark, sf_dir)
    blinded = materialize(passes.blind_texts(texts(spark, sf_dir), "doc_id", chosen).select("doc_id", "blinded"), "blinded")
    known = names.select(F.col("surface").alias("value")).union(minting.pair_map(items, STOP).select("value")).union(minted.select("value")).distinct()
    return rewrite.leaks(blinded, "doc_id", "blinded", known)


@_query("novel_names")
def novel_names(spark, sf_dir):
    """Capitalised words of blinded documents that nothing explains; a rule on their length stands in for a model."""
    chosen, _ = chosen_spans(spark, sf_dir)
    blinded = passes.blind_texts(texts(spark, sf_dir), "doc_id", chosen, own="values").select("doc_id", F.col("blinded").alias("text"), "values")
    harmless = table(spark, sf_dir, "benchmark").select(F.explode(words.words(F.col("text"))).alias("word"))
    return passes.novel_names(blinded, "doc_id", None, harmless, STOP, lambda word, context: F.length(word) > 6)


# Payloads: each turn of a conversation, blinded by the dictionary and the open items.
_TURNS = "(SELECT conv_id * 1000 + turn AS leaf, text FROM conversations)"
TURNS_SQL = all_spans_sql(_TURNS, "leaf", contact=False)


def _blinded_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rewritten payloads, the spans chosen and the original payloads."""
    sent = materialize(requests(spark, sf_dir), "payloads")
    parts = materialize(payloads.leaves(sent).where("part is not null"), "leaves")
    keyed = parts.select(F.struct("exchange_id", "leaf_no").alias("leaf"), "text")
    chosen, _ = passes.deterministic_spans(keyed, "leaf", *_names(spark, sf_dir), STOP, KINDS, BEYOND)
    chosen = materialize(chosen, "chosen")
    rewritten = passes.blind_texts(keyed, "leaf", chosen).where("n_spans > 0").select("leaf.*", F.col("blinded").alias("text"))
    return payloads.rebuild(sent, rewritten), chosen, sent


@_query(
    "payload_rewrite",
    f"""WITH {TURNS_SQL}, pieces AS (SELECT l.leaf, l.s, substr(t.text, coalesce(lag(l.e) OVER w, 0) + 1, l.s - coalesce(lag(l.e) OVER w, 0)) || l.surrogate AS piece, l.e
  FROM chosen l JOIN {_TURNS} t USING (leaf) WINDOW w AS (PARTITION BY l.leaf ORDER BY l.s)),
woven AS (SELECT leaf, string_agg(piece, '' ORDER BY s) AS head, max(e) AS upto FROM pieces GROUP BY leaf)
SELECT leaf // 1000 AS exchange_id, row_number() OVER (PARTITION BY leaf // 1000 ORDER BY leaf) - 1 AS hop_index,
  CASE WHEN head IS NULL THEN text ELSE head || substr(text, upto + 1) END AS text FROM {_TURNS} LEFT JOIN woven USING (leaf)""",
)
def payload_rewrite(spark, sf_dir):
    """Both dialects: leaves out, blinded, and back into their payloads."""
    return payloads.hops(_blinded_requests(spark, sf_dir)[0]).select("exchange_id", "hop_index", "text")


@_query(
    "count_tokens_dry_run",
    f"""WITH {TURNS_SQL} SELECT conv_id AS exchange_id, count(DISTINCT surrogate) AS n_surrogates, count(surrogate) AS n_spans
FROM conversations LEFT JOIN chosen ON leaf = conv_id * 1000 + turn GROUP BY conv_id""",
)
def count_tokens_dry_run(spark, sf_dir):
    """What a request would put in: the rewrite alone, nothing restored or stored."""
    _, chosen, sent = _blinded_requests(spark, sf_dir)
    counted = chosen.groupBy("leaf.exchange_id").agg(F.count_distinct("surrogate").alias("n_surrogates"), F.count("*").alias("n_spans"))
    return sent.select("exchange_id").join(counted, "exchange_id", "left").na.fill(0)


@_query("payload_round_trip", "SELECT conv_id AS exchange_id, true AS same FROM conversations GROUP BY conv_id")
def payload_round_trip(spark, sf_dir):
    """Rewritten payloads, read again and restored leaf by leaf, equal the originals but for variations, which come back as canonical names."""
    blinded, chosen, sent = _blinded_requests(spark, sf_dir)
    blinded = materialize(blinded, "rewritten-payloads")
    keyed = lambda found: found.select(F.struct("exchange_id", "leaf_no").alias("leaf"), "text")
    unkeyed = lambda texts, text: texts.where(F.col("text") != F.col(text)).select("leaf.*", F.col(text).alias("text"))
    originals = keyed(materialize(payloads.leaves(sent).where("part is not null"), "original-leaves"))
    # Each leaf is its own exchange.
    session = rewrite.session_of(originals, "leaf", chosen.select("leaf", "s", "e", "surrogate", F.col("real").alias("value")))
    back = rewrite.restore(keyed(payloads.leaves(blinded)), "leaf", session)
    whole = payloads.rebuild(blinded, unkeyed(back, "restored"))
    named = rewrite.blind(originals, "leaf", chosen.select("leaf", "s", "e", F.col("real").alias("surrogate")))
    wanted = payloads.rebuild(sent, unkeyed(named, "blinded"))
    old, new = (F.try_parse_json(c).cast("string") for c in ("payload", "back"))
    joined = wanted.join(whole.select("exchange_id", F.col("payload").alias("back")), "exchange_id")
    return joined.select("exchange_id", (old == new).alias("same"))


@_query(
    "tool_prose_rewrite",
    """WITH names AS (SELECT DISTINCT p_name FROM part), ranked AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS k FROM names)
SELECT p_partkey AS exchange_id, 'Make a Vor' || k || ' Nach' || k || ', please' AS description, 'size of Vor' || k || ' Nach' || k AS inner_description, p_name AS name FROM part JOIN ranked USING (p_name)""",
)
def tool_prose_rewrite(spark, sf_dir):
    """Descriptions of tools and of their schemas are rewritten by the open items; names and types stay."""
    parts = table(spark, sf_dir, "part")
    schema = "named_struct('type', 'object', 'properties', named_struct('description', named_struct('type', 'string', 'description', concat('size of ', p_name))))"
    tool = f"named_struct('name', p_name, 'description', concat('Make a ', p_name, ', please'), 'input_schema', {schema})"
    sent = parts.selectExpr("p_partkey AS exchange_id", f"to_json(named_struct('messages', array(), 'tools', array({tool}))) AS payload")
    names = parts.select("p_name").distinct()
    numbered = with_ordinal(names.selectExpr("p_name AS value", "0 AS _all"), ["_all"], ["value"])
    ordinal = numbered.select("value", (F.col("ordinal") + 1).alias("item_id"))
    items = ordinal.selectExpr("item_id", "value", "'term' AS entity_type", "concat('Vor', item_id, ' Nach', item_id) AS surrogate")
    found = materialize(payloads.leaves(sent, parts=("tool", "schema")), "tool-prose")
    rewritten = passes.apply_pairs(found.select(F.struct("exchange_id", "leaf_no").alias("leaf"), "text"), "leaf", items, STOP)
    done = payloads.rebuild(sent, rewritten.select("leaf.*", F.col("blinded").alias("text")))
    at = "$.tools[0]"
    get = lambda path: F.get_json_object("payload", f"{at}.{path}")
    return done.select("exchange_id", get("description").alias("description"), get("input_schema.properties.description.description").alias("inner_description"), get("name").alias("name"))


def _declaring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that declare a tool named after a part: even ones in one dialect, odd ones in the other."""
    plain = "named_struct('name', p_name, 'description', concat('Make a ', p_name))"
    wrapped = "named_struct('function', named_struct('name', p_name, 'description', concat('Make a ', p_name)))"
    one = "to_json(named_struct('messages', array(), 'tools', array({})))"
    payload = f"CASE WHEN p_partkey % 2 = 0 THEN {one.format(plain)} ELSE {one.format(wrapped)} END AS payload"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS exchange_id", payload)


@_query("declared_tool_names", "SELECT p_partkey AS exchange_id, p_name AS name FROM part")
def declared_tool_names(spark, sf_dir):
    return payloads.tool_names(_declaring(spark, sf_dir))


@_query("payload_gate", "SELECT p_partkey AS exchange_id, p_name AS value, unnest(['leak', 'declared']) AS what FROM part")
def payload_gate(spark, sf_dir):
    """Each part's name leaks from a description, and collides where it names a tool."""
    found = materialize(payloads.checked_leaves(payloads.leaves(_declaring(spark, sf_dir))), "checked-leaves")
    known = table(spark, sf_dir, "part").select(F.col("p_name").alias("value")).distinct()
    leaked, declared = rewrite.payload_gate(found, known)
    return leaked.withColumn("what", F.lit("leak")).unionByName(declared.withColumn("what", F.lit("declared")))


def blinded_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blinded documents as answers of both dialects, and the session of each: (``exchange_id``, ``payload``), session."""
    docs = texts(spark, sf_dir)
    located, _ = rewrite.contact_data(docs, "doc_id", KINDS, BEYOND)
    blinded = rewrite.blind(docs, "doc_id", located).selectExpr("doc_id AS exchange_id", "blinded")
    blocks = "to_json(named_struct('content', array(named_struct('type', 'text', 'text', blinded, 'input', null), named_struct('type', 'tool_use', 'text', null, 'input', named_struct('q', blinded)))))"
    chat = "to_json(named_struct('choices', array(named_struct('message', named_struct('role', 'assistant', 'content', blinded, 'tool_calls', array(blinded))))))"
    answers = blinded.selectExpr("exchange_id", f"CASE WHEN exchange_id % 2 = 0 THEN {blocks} ELSE {chat} END AS payload")
    session = rewrite.session_of(docs, "doc_id", located).withColumnRenamed("doc_id", "exchange_id")
    return materialize(answers, "answers"), materialize(session, "sessions")


@_query("response_restore", "SELECT doc_id AS exchange_id, text AS answer, CASE WHEN doc_id % 2 = 0 THEN text END AS tool_input FROM documents")
def response_restore(spark, sf_dir):
    """Text blocks and tool inputs of one dialect, message contents of the other."""
    answers, session = blinded_answers(spark, sf_dir)
    restored = payloads.restore_payloads(answers, session)
    get = lambda path: F.get_json_object("payload", path)
    return restored.select(
        "exchange_id", F.coalesce(get("$.content[0].text"), get("$.choices[0].message.content")).alias("answer"), get("$.content[1].input.q").alias("tool_input")
    )


def _sessions_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = (F.array(*map(F.lit, x)) for x in (minting.FIRST, minting.LAST))
    k = F.col("p_partkey")
    surrogate = F.concat_ws(" ", F.element_at(first, (k % len(minting.FIRST) + 1).cast("int")), F.element_at(last, (F.floor(k / 8) % len(minting.LAST) + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", surrogate.alias("surrogate"), F.initcap("p_name").alias("real"))


_INITCAP = "(list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' '))"


_LAST = "['" + "', '".join(minting.LAST) + "']"


@_query(
    "restore_full_and_components",
    f"""SELECT p_partkey, r || ' met ' || split_part(r, ' ', 1) || ', not ' || s || 'land: ' || split_part(r, ' ', 2) AS restored
FROM (SELECT p_partkey, {_INITCAP} AS r, {_LAST}[p_partkey // 8 % {len(minting.LAST)} + 1] AS s FROM part)""",
)
def restore_full_and_components(spark, sf_dir):
    """A whole surrogate and its single words become real again; a longer word that holds one stays."""
    session = _sessions_of_parts(spark, sf_dir)
    parts = F.split("surrogate", " ")
    said = session.select("p_partkey", F.concat("surrogate", F.lit(" met "), parts[0], F.lit(", not "), parts[1], F.lit("land: "), parts[1]).alias("text"))
    return rewrite.restore(said, "p_partkey", session.withColumn("seq", F.lit(0))).select("p_partkey", "restored")


@_query("restore_suffix_transfer", f"SELECT p_partkey, r || 's Haus, ' || r || '''s and ' || split_part(r, ' ', 2) || 'en' AS restored FROM (SELECT p_partkey, {_INITCAP} AS r FROM part)")
def restore_suffix_transfer(spark, sf_dir):
    session = _sessions_of_parts(spark, sf_dir)
    said = session.select("p_partkey", F.concat("surrogate", F.lit("s Haus, "), "surrogate", F.lit("'s and "), F.split("surrogate", " ")[1], F.lit("en")).alias("text"))
    return rewrite.restore(said, "p_partkey", session.withColumn("seq", F.lit(0))).select("p_partkey", "restored")


def event_chunks(spark: SparkSession, sf_dir: str, size: int = 300, leaky: bool = False) -> tuple[DataFrame, DataFrame]:
    """Blinded documents as streams of events cut into raw chunks, and their sessions. Every fifth breaks off.

    With ``leaky`` every second one has a surrogate as a key of its tool input, which restoring leaves alone.
    """
    docs = texts(spark, sf_dir)
    located = materialize(rewrite.contact_data(docs, "doc_id", KINDS, BEYOND)[0], "located")
    session = located.selectExpr("doc_id AS exchange_id", "surrogate", "value AS real", "s AS seq")
    known = rewrite.session_of(docs, "doc_id", located).withColumnRenamed("doc_id", "exchange_id")
    back = known.groupBy("exchange_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("surrogate", "real")))).alias("session"))
    # Stored, its size is known: where few texts hold contact data, it is sent to the texts and not they to it.
    back = materialize(back, "session-maps")
    blinded = rewrite.blind(docs, "doc_id", located).selectExpr("doc_id AS exchange_id", "blinded")
    keys = session.where("exchange_id % 2 = 0" if leaky else "false").groupBy("exchange_id").agg(F.min("surrogate").alias("mark"))
    blinded = blinded.join(keys, "exchange_id", "left")

    def event(name: str, data: str) -> str:
        return f"concat('event: {name}\\ndata: ', to_json({data}), '\\n\\n')"

    half = "cast(length(blinded) / 2 as int)"
    tool = "CASE WHEN mark IS NULL THEN to_json(named_struct('q', blinded)) ELSE to_json(map('q', blinded, mark, 'key')) END"
    delta = lambda i, kind, field, text: event("content_block_delta", f"named_struct('index', {i}, 'delta', named_struct('type', '{kind}', '{field}', {text}))")
    stop = lambda i: event("content_block_stop", f"named_struct('index', {i})")
    parts = [
        event("message_start", "named_struct('n', 1)"),
        delta(0, "text_delta", "text", f"substring(blinded, 1, {half})"),
        delta(0, "text_delta", "text", f"substring(blinded, {half} + 1)"),
        stop(0),
        event("content_block_start", "named_struct('index', 1, 'content_block', named_struct('type', 'tool_use'))"),
        delta(1, "input_json_delta", "partial_json", f"substring({tool}, 1, 9)"),
        delta(1, "input_json_delta", "partial_json", f"substring({tool}, 10)"),
        stop(1),
    ]
    end = f"CASE WHEN exchange_id % 5 = 0 THEN '' ELSE {event('message_stop', 'named_struct(' + chr(39) + 'n' + chr(39) + ', 2)')} END"
    streams = blinded.selectExpr("exchange_id", f"concat({', '.join([*parts, end])}) AS raw").join(back, "exchange_id", "left")
    # Cut from left to right in one go: a substring is counted from the start of the text each time.
    cut = F.posexplode(F.regexp_extract_all("raw", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("k", "chunk")
    chunks = streams.select("exchange_id", F.coalesce("session", F.lit("{}")).alias("session"), cut)
    # The first chunk brings the session: on every chunk it would travel as often as a text is long.
    chunks = chunks.select("exchange_id", F.col("k").cast("long").alias("seq"), "chunk", F.when(F.col("k") == 0, F.col("session")).alias("session"))
    return materialize(chunks, "event-chunks"), session


_STREAMED = "SELECT doc_id AS exchange_id, 0::BIGINT AS block, 'text' AS kind, text FROM documents WHERE text <> '' UNION ALL SELECT doc_id, 1, 'tool_input', text FROM documents"


def _readable(sent: DataFrame) -> DataFrame:
    return sent.withColumn("text", F.when(F.col("kind") == events.TOOL, F.get_json_object("text", "$.q")).otherwise(F.col("text")))


@_query("sse_restore", _STREAMED)
def sse_restore(spark, sf_dir):
    """Events parsed from raw chunks, text restored as it comes and tool input as a whole."""
    chunks, _ = event_chunks(spark, sf_dir)
    return _readable(events.streamed_text(events.restore_events_at_rest(chunks)))


@_query("sse_restore_stream", _STREAMED)
def sse_restore_stream(spark, sf_dir):
    """The same by a stream with state."""
    chunks, _ = event_chunks(spark, sf_dir)
    out = new_path(spark, "events")
    stream = spark.readStream.schema(chunks.schema).parquet(path_of(chunks))
    ordered.start(events.restore_events(stream), out).awaitTermination()
    release(chunks)
    return _readable(events.streamed_text(spark.read.schema(events.OUTPUT).parquet(out)))


@_query(
    "sse_outcomes",
    f"""WITH {pii.FOUND}, {pii.DISJOINT}, leaky AS (SELECT DISTINCT doc_id FROM disjoint WHERE doc_id % 2 = 0)
SELECT d.doc_id AS exchange_id, CASE WHEN l.doc_id IS NOT NULL THEN 'blocked' WHEN d.doc_id % 5 = 0 THEN 'upstream_error' ELSE 'forwarded' END AS outcome,
  (l.doc_id IS NOT NULL)::BIGINT AS n_unresolved FROM documents d LEFT JOIN leaky l ON l.doc_id = d.doc_id""",
)
def sse_outcomes(spark, sf_dir):
    """The gate at the end of each stream: surrogates that went out, and streams that broke off."""
    chunks, session = event_chunks(spark, sf_dir, leaky=True)
    rows = materialize(events.restore_events_at_rest(chunks), "events")
    return events.stream_outcomes(rows, session)


@_query(
    "l1_all_kinds",
    f"WITH {pii.ALL_FOUND} SELECT doc_id, kind, value, s, e FROM found",
)
def l1_all_kinds(spark, sf_dir):
    """Every recogniser over all documents."""
    return detect.pii_spans(texts(spark, sf_dir), "doc_id")


@_query("prose_lowercase_counts", f"""WITH t AS (SELECT conv_id, unnest(regexp_extract_all(regexp_replace(text, '{candidates.NOT_PROSE}', ' ', 'g'), '{W}')) AS word FROM conversations)
SELECT conv_id, replace(lower(word), 'ß', 'ss') AS folded, count(*) AS n FROM t WHERE regexp_matches(word, '^\\p{{Ll}}+$') GROUP BY ALL""")  # fmt: skip
def prose_lowercase_counts(spark, sf_dir):
    """Lower-case words outside links, addresses and dotted or hyphenated names."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.explode(words.words(candidates.prose(F.col("text")))).alias("word"))
    low = rows.where(F.col("word").rlike(r"^\p{Ll}+$"))
    return low.groupBy("conv_id", F.replace(F.lower("word"), F.lit("ß"), F.lit("ss")).alias("folded")).agg(F.count("*").alias("n"))

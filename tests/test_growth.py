"""Steps whose work must not grow faster than their input."""

import json
import time

from pyspark.sql import functions as F

from maskwell.operators import dictionary, graph, history, rewrite, store
from maskwell.sources import files, payloads
from maskwell.streaming import events


def test_keys_asked_for_at_once_are_those_asked_for_one_by_one():
    every = b"\xff" * (dictionary.FILTER_BITS // 8)
    rows = [("Bern hard", 2), ("B ern hard", 3), ("Müller", 1), ("x", 1), ("Nordlichtgesellschaftshaus", 1), ("aaaa", 1)]
    folded = [p.lower().replace("ü", "u") for p, _ in rows]
    got = dictionary.known_keys([p for p, _ in rows], folded, [k for _, k in rows], every, True)
    assert got == {r: {p[0] + x for x in dictionary.phrase_keys(f, k - 1)} for r, ((p, k), f) in enumerate(zip(rows, folded, strict=True))}
    bits, gone = dictionary.remnant_bits(["hart", "hurt"], ["h", "h"], 2)
    names, _ = dictionary.remnant_bits(["hrt"], ["h"], 2)
    assert len(gone) == bits.shape[1] == 7 and all(names[0, 0] in row for row in bits)


def test_a_long_text_with_many_spans_is_spliced_in_one_pass(spark):
    n = 40_000
    text = "é" * 80 * n
    located = spark.range(n).select(F.lit(1).alias("id"), (F.col("id") * 80).cast("int").alias("s"), (F.col("id") * 80 + 40).cast("int").alias("e"), F.lit("X").alias("surrogate"))
    began = time.perf_counter()
    row = rewrite.blind(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", located).where("id = 1").first()
    assert row.n_spans == n and row.blinded == ("X" + "é" * 40) * n
    assert time.perf_counter() - began < 30


def test_a_version_travels_twice_at_most(spark):
    ends = [(a, b) for a in (0, 17, 10**6, 4095) for b in (1, 15, 16, 17, 4096, 86_400, 10**8)]
    frame = spark.createDataFrame([(a, a + b) for a, b in ends], "a long, b long").select(F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    for row in frame.select(F.unix_seconds("a").alias("at"), F.unix_seconds("b").alias("upto"), history.holding(F.col("a"), F.col("b")).alias("p")).collect():
        assert len(row.p) <= 2 and row.p[0].block * 16 ** row.p[0].level <= row.at and row.upto < (row.p[-1].block + 1) * 16 ** row.p[0].level
    open_end = frame.select(history.holding(F.col("a"), F.lit(None).cast("timestamp")).alias("p")).first()
    assert len(open_end.p) <= 3


def test_captures_share_files_and_end_at_their_broken_line(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id % 500 AS k", "id AS n", "CASE WHEN id = 1001 THEN '{broken' ELSE '{\"record\":\"x\"}' END AS body")
    files.write_captures(rows, f"{tmp_path}/c", "k", "n", "body")
    files.write_captures(rows.selectExpr("k", "n + 2000 AS n", "'{\"record\":\"footer\"}' AS body").where("k = 7"), f"{tmp_path}/c", "k", "n", "body")
    assert len(list((tmp_path / "c").glob("part-*"))) < 20
    got = {r.file: (r.n_records, r.status) for r in files.capture_status(files.read_captures(spark, f"{tmp_path}/c", packed=True)).collect()}
    assert len(got) == 500 and got["1"] == (2, "in-flight") and got["7"] == (8, "complete") and got["8"] == (4, "in-flight")


def test_exchanges_at_rest_are_read_in_one_pass_without_a_call_for_each(spark):
    said = 'event: content_block_delta\r\ndata: {"index": 0, "delta": {"type": "text_delta", "text": "to Vogt"}}\r\n\r\n'
    stop = 'event: content_block_stop\ndata: {"index": 0}\n\nevent: message_stop\ndata: {}\n\n'
    rows = []
    for exchange in range(300):
        raw, real = said + (stop if exchange % 3 else ""), json.dumps({"Vogt": f"Lee{exchange}"})
        cut = [raw[at : at + 7] for at in range(0, len(raw), 7)]
        # The first number may be any; one that comes twice counts once, and the first chunk brings the session.
        rows += [(exchange, k - 1, piece, real if k == 0 else None) for k, piece in enumerate(cut)] + [(exchange, 3, cut[4], None)]
    chunks = spark.createDataFrame([*rows, (None, 0, said, None), (1, None, said, None)], "exchange_id long, seq long, chunk string, session string")
    found = events.restore_events_at_rest(chunks)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    sent = {r.exchange_id: r.text for r in events.streamed_text(found).collect()}
    assert sent == {exchange: f"to Lee{exchange}" for exchange in range(300)}
    lost = {r.exchange_id for r in found.where("kind = 'disconnected'").collect()}
    assert lost == set(range(0, 300, 3))


def test_a_bundle_loaded_on_another_takes_its_rows_from_the_store(spark):
    kinds = "CASE WHEN id < 900 THEN 'person' WHEN id < 990 THEN 'term' ELSE 'other' END AS kind"
    every = spark.range(1000).selectExpr("concat('w', id % 3) AS workspace", "id AS entity_id", kinds, "concat('n', id) AS canonical", "array('v') AS variations", "'s' AS surrogate")
    # Most edges go to one target; others have odd relations, the wrong direction, null or missing ends.
    links = spark.range(20_000).selectExpr(
        "CASE WHEN id % 97 = 0 THEN NULL ELSE id % 1010 END AS source_id",
        "CASE id % 4 WHEN 0 THEN 'employer' WHEN 1 THEN 'subsidiary_of' WHEN 2 THEN 'alias-of' ELSE NULL END AS relation",
        "CASE WHEN id % 10 < 8 THEN 950 WHEN id % 10 = 8 THEN id % 1010 END AS target_id",
    )
    once = store.seed_commit(every.where("entity_id % 3 = 0"), links.limit(0), every, links)
    twice = store.seed_commit(*once, every, links)
    for table in twice:
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    # A null relation is no known one.
    want = graph.edge_problems(links.where("relation IS NOT NULL"), every.select("entity_id", "kind")).where("size(problems) = 0").select(*links.columns).distinct()
    got = [tuple(r) for r in twice[1].collect()]
    assert len(got) == len(set(got)) > 300 and set(got) == {tuple(r) for r in want.collect()}
    assert twice[0].count() == twice[0].select("workspace", "entity_id").distinct().count() == 1000


def test_payloads_of_one_split_are_read_by_all_tasks(spark):
    prose = F.concat(*[F.sha2(F.concat("id", F.lit(f"/{k}")), 512) for k in range(10)])
    body = F.to_json(F.struct(F.array(F.struct(prose.alias("description"))).alias("tools")))
    sent = spark.range(0, 8000, 1, 1).select(F.col("id").alias("exchange_id"), body.alias("payload"))
    found = payloads.leaves(sent).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in found) == 8000 and len(found) >= 3 and max(r["count"] for r in found) < 4000


def test_only_asked_parts_leave_the_workers_with_their_numbers_and_any_type_of_block_is_read(spark):
    body = {"messages": [{"content": [{"type": ["text"], "text": "a"}, {"type": "text", "text": "b"}]}], "tools": [{"name": "n", "description": "c"}]}
    sent = spark.createDataFrame([(1, json.dumps(body))], "exchange_id long, payload string")
    every = [(r.leaf_no, r.part, r.text) for r in payloads.leaves(sent).orderBy("leaf_no").collect()]
    assert every == [(0, None, "text"), (1, None, "a"), (2, None, "text"), (3, "content", "b"), (4, None, "n"), (5, "tool", "c")]
    assert [(r.leaf_no, r.text) for r in payloads.leaves(sent, parts=("tool",)).collect()] == [(5, "c")]
    new = payloads.rebuild(sent, spark.createDataFrame([(1, 3, "B"), (1, 5, "C")], "exchange_id long, leaf_no long, text string")).first().payload
    body["messages"][0]["content"][1]["text"], body["tools"][0]["description"] = "B", "C"
    assert json.loads(new) == body

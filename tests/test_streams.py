"""Streams over several micro-batches: order, repeats, time-outs, ends, and events that cannot be read."""

import datetime
import json
import os
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from maskwell.shared import new_path
from maskwell.streaming import events, ordered, restore

BACK = {"Bernd Vogt": "Anna Lee", "Vogt": "Lee"}
SCHEMA = "exchange_id long, seq long, chunk string, last boolean, session string, at timestamp"
START = datetime.datetime(2024, 1, 1)


def write_batches(spark, folder, batches):
    """One file per batch, read in this order; a row is (exchange, seq, chunk, last, minutes)."""
    os.makedirs(folder, exist_ok=True)
    for k, batch in enumerate(batches):
        path = f"{folder}/batch-{k}.json"
        with open(path, "w") as f:
            for exchange, seq, chunk, last, minutes in batch:
                at = (START + datetime.timedelta(minutes=minutes)).isoformat()
                row = {"exchange_id": exchange, "seq": seq, "chunk": chunk, "last": last, "session": json.dumps(BACK), "at": at}
                f.write(json.dumps(row) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)


def pieces(spark, out):
    rows = spark.read.schema(restore.OUTPUT).parquet(out).orderBy("exchange_id", "seq", "n").collect()
    found = {}
    for r in rows:
        text, _ = found.get(r.exchange_id, ("", None))
        found[r.exchange_id] = (text + r.piece, r.state)
    return found


def test_chunks_of_later_batches_take_their_place(spark, tmp_path):
    batches = [
        [(1, 2, "gt's car, ", False, 0), (2, 0, "Vog", False, 0), (None, 0, "x", False, 0), (3, None, "x", False, 0)],
        [(1, 3, "then Vogt", False, 0), (1, 0, "met Be", False, 0), (1, 0, "met Be", False, 0), (2, 2, "!", True, 0)],
        [(1, 1, "rnd Vo", False, 0), (1, 2, "gt's car, ", False, 0)],
        [(1, 5, ".", True, 0), (1, 4, None, False, 0), (2, 1, "t", False, 0)],
        [(1, 1, "again", False, 0), (2, 3, "after the end", False, 0)],
    ]
    stream = write_batches(spark, str(tmp_path / "in"), batches)
    out, state = new_path(spark, "out"), new_path(spark, "state")
    ordered.start(restore.restore_stream(stream), out, state).awaitTermination()
    want = {1: ("met Anna Lee's car, then Lee.", "ended"), 2: ("Lee!", "ended")}
    assert pieces(spark, out) == want
    # A restart from the checkpoint reads nothing again.
    ordered.start(restore.restore_stream(stream), out, state).awaitTermination()
    assert pieces(spark, out) == want


def test_an_exchange_that_falls_silent_is_given_up_by_the_watermark(spark, tmp_path):
    batches = [
        [(1, 0, "met Bernd Vo", False, 0), (1, 2, "behind the gap", False, 0), (2, 0, "Vogt and ", False, 0)],
        [(2, 1, "Vogt", False, 8)],
        [(3, 0, "other", False, 25)],
        [(3, 1, " end", True, 26), (1, 1, "gt", False, 26)],
    ]
    stream = write_batches(spark, str(tmp_path / "in"), batches)
    out = new_path(spark, "out")
    ordered.start(restore.restore_stream(stream, idle_ms=600_000, arrival="at", late="1 minute"), out).awaitTermination()
    assert pieces(spark, out) == {1: ("met Bernd Vo", "disconnected"), 2: ("Lee and Lee", "disconnected"), 3: ("other end", "ended")}


def test_an_exchange_that_falls_silent_is_given_up_by_the_clock(spark, tmp_path):
    stream = write_batches(spark, str(tmp_path / "in"), [[(1, 0, "to Vogt", False, 0), (2, 0, "by Vogt", True, 0)]])
    out = new_path(spark, "out")
    query = ordered.start(restore.restore_stream(stream, idle_ms=1000), out, at_rest=False)
    try:
        until = time.time() + 120
        while time.time() < until and len(pieces(spark, out) if query.lastProgress else {}) < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    assert pieces(spark, out) == {1: ("to Lee", "disconnected"), 2: ("by Lee", "ended")}


def event(name, body):
    return f"event: {name}\ndata: {json.dumps(body)}\n\n"


def answer(text, ended):
    parts = [
        event("content_block_start", {"index": 0, "content_block": {"type": "text"}}),
        event("content_block_delta", {"index": 0, "delta": {"type": "text_delta", "text": text}}),
        event("content_block_stop", {"index": 0}) if ended else "",
        event("message_stop", {}) if ended else "",
    ]
    return "".join(parts)


def test_streams_of_events_end_by_their_last_event_or_by_a_time_out(spark, tmp_path):
    whole, cut = answer("it is Bernd Vogt", True), answer("it is Bernd Vogt", False)
    batches = [
        [(1, 1, whole[30:90], None, 0), (2, 0, cut[:50], None, 0)],
        [(1, 2, whole[90:], None, 1), (2, 1, cut[50:], None, 1), (1, 0, whole[:30], None, 1)],
        [(3, 0, whole, None, 30)],
        [(3, 1, whole, None, 31)],
    ]
    stream = write_batches(spark, str(tmp_path / "in"), batches).drop("last")
    out = new_path(spark, "out")
    ordered.start(events.restore_events(stream, idle_ms=600_000, arrival="at"), out).awaitTermination()
    rows = spark.read.schema(events.OUTPUT).parquet(out)
    assert {(r.exchange_id, r.text) for r in events.streamed_text(rows).collect()} == {(k, "it is Anna Lee") for k in (1, 2, 3)}
    assert [r.exchange_id for r in rows.where(F.col("kind") == events.LOST).collect()] == [2]


def test_events_follow_the_format_of_event_streams():
    assert events.fields(": note\nevent:a\nid\ndata: one\ndata:  two\nevent: b:c\nretry:") == {
        "event": "b:c", "data": "one\n two", "id": "", "retry": "",
    }
    raw = "event: a\r\ndata: 1\r\n\r\nevent: b\rdata: 2\r\rdata: 3\n\n\n\ndata: 4"
    for size in range(1, len(raw) + 1):
        kept, found = {}, []
        for at in range(0, len(raw), size):
            found += events.split_events(kept, raw[at : at + size], at + size >= len(raw))
        assert found == ["event: a\ndata: 1", "event: b\ndata: 2", "data: 3", "data: 4"]


@pytest.mark.parametrize(
    "raw",
    [
        event("content_block_delta", {"index": "one", "delta": {"type": "text_delta", "text": "Vogt"}}),
        event("content_block_delta", {"index": None, "delta": {"type": "text_delta", "text": "Vogt"}}),
        event("content_block_delta", {"index": 10**30, "delta": {"type": "text_delta", "text": "Vogt"}}),
        event("content_block_delta", {"index": 0, "delta": ["text_delta"]}),
        event("content_block_delta", {"index": 0, "delta": {"type": "text_delta", "text": 7}}),
        event("content_block_start", {"index": 0, "content_block": ["tool_use"]}),
        event("content_block_stop", {"index": True}),
        event("content_block_stop", [1]),
        "event: content_block_delta\ndata: {broken\n\n",
        "event: content_block_delta\ndata: " + "[" * 100_000 + "\n\n",
        "no field at all\n\n",
        "data\n\n",
    ],
)
def test_events_without_the_form_of_their_name_pass_as_they_stand(raw):
    kept = {}
    rows = events.advance(kept, raw + answer("Vogt", True), BACK)
    assert rows[0][2:] == (events.PASSED, raw.strip("\n"))
    assert [r[3] for r in rows if r[2] == events.TEXT] == ["Lee"]
    json.dumps(kept)


@pytest.mark.parametrize("session", [None, "", "{", "[1]", '{"Vogt": 5}', "7"])
def test_a_session_that_is_no_map_restores_nothing(session):
    assert ordered.session_of(session) == {}


@pytest.mark.parametrize(
    "given,want",
    [
        ('{"Vogt": "Vogt", "n": [1.50, "a\\"Vogt"]}', '{"Vogt": "Lee", "n": [1.50, "a\\"Lee"]}'),
        ('{"q": "Bernd Vogt', '{"q": "Anna Lee'),
        ('{"q": "tail \\', '{"q": "tail \\'),
        ("Vogt", "Lee"),
        ("", ""),
        ("[" * 50_000 + '"Vogt"', "[" * 50_000 + '"Lee"'),
    ],
)
def test_tool_input_is_restored_string_by_string(given, want):
    assert events.restore_tool_json(given, BACK) == want


class Told:
    """A state that counts the calls to it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.held.get("place")

    def update(self, value):
        self.calls += 1
        self.held["place"] = value

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]

    def clear(self):
        self.calls += 1
        self.held = {k: v for k, v in self.held.items() if k == "place"}


def test_an_exchange_in_one_batch_asks_its_state_twice_and_needs_no_frame():
    columns = [c.split(" ")[0] for c in events.OUTPUT.split(", ")]
    raw = answer("it is Bernd Vogt", True)
    cut = [raw[at : at + 20] for at in range(0, len(raw), 20)]
    # Repeated, out of order, one null, the session on the first chunk only.
    rows = [Row(7, k, piece, False, json.dumps(BACK) if k == 0 else None) for k, piece in enumerate(cut)] + [Row(7, 0, "other", False, None)]
    whole, parted = Told(), Told()
    processor = ordered.InOrder(events._feed, events._finish, columns, None, False)
    processor.init(whole)
    found = list(processor.handleInputRows((7,), iter([*rows[-2::-1], rows[-1]]), None))
    assert whole.calls == 2 and whole.held["place"][2] == ordered.ENDED
    assert "".join(r.text for r in found if r.kind == events.TEXT) == "it is Anna Lee"
    # In two batches of which the first lacks its first chunk, early ones wait in the state and go at the end.
    processor.init(parted)
    assert list(processor.handleInputRows((7,), iter(rows[1:-1]), None)) == []
    later = list(processor.handleInputRows((7,), iter(rows[:1]), None))
    assert [r.text for r in later] == [r.text for r in found] and list(parted.held) == ["place"]
    assert list(processor.handleInputRows((7,), iter(rows[:1]), None)) == []

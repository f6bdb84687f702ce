"""Server-sent events of streamed answers: parsing, restoring and the gate at the end of a stream.

A stream is a table of ``exchange_id``, ``seq``, ``chunk``, ``session``: raw pieces cut anywhere,
and the exchange's map surrogate -> real as JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.operators import rewrite
from maskwell.streaming.ordered import in_order, session_of
from maskwell.streaming.restore import pattern_of, step

OUTPUT = "exchange_id long, seq long, n long, event string, block long, kind string, text string"
_SHAPE = pa.schema([(name, {"long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (c.split(" ") for c in OUTPUT.split(", "))])
#: Output rows of one batch of a table at rest.
ROWS = 1024
#: Kinds of rows: restored text, restored tool input, an event passed on, an exchange given up.
TEXT, TOOL, PASSED, LOST = "text", "tool_input", "event", "disconnected"
#: A JSON string with the colon that makes it a key, if any; the last one may be cut off.
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)(?:"(\s*:)?|$)', re.DOTALL)


def fields(event: str) -> dict[str, str]:
    """Fields of one event as the event-stream format has them.

    A field's name ends at the first colon of its line, one blank behind that colon goes, and
    values of a repeated ``data`` are lines of one value. Lines that begin with a colon are
    comments; of other repeated fields the last counts.
    """
    out: dict[str, str] = {}
    for line in event.split("\n"):
        name, _, value = line.partition(":")
        if not name:
            continue
        value = value.removeprefix(" ")
        out[name] = f"{out[name]}\n{value}" if name == "data" and name in out else value
    return out


def body_of(data: str | None) -> dict:
    """The JSON object of an event's data; anything else, broken or nested too deep, is empty."""
    try:
        body = json.loads(data or "")
    except (ValueError, RecursionError):
        return {}
    return body if isinstance(body, dict) else {}


def restore_tool_json(assembled: str, back: dict[str, str]) -> str:
    """Tool input put together from its deltas, string by string; keys stay.

    The text need not be whole JSON: a string that is cut off is restored up to its end, and
    what stands outside strings as it is.
    """
    if not back:
        return assembled
    pattern = pattern_of(list(back))

    def real(text: str) -> str:
        return pattern.sub(lambda m: back[m[1]] + (m[2] or ""), text)

    def literal(m: re.Match[str]) -> str:
        if m[2] is not None:
            return m[0]
        closed = len(m[0]) > len(m[1]) + 1
        try:
            value = json.dumps(real(json.loads(f'"{m[1]}"', strict=False)), ensure_ascii=False)
        except ValueError:
            value = f'"{real(m[1])}"'
        return value if closed else value[:-1]

    out, at = [], 0
    for m in _LITERAL.finditer(assembled):
        out += [real(assembled[at : m.start()]), literal(m)]
        at = m.end()
    return "".join([*out, real(assembled[at:])])


def split_events(kept: dict, chunk: str, ended: bool) -> list[str]:
    """Whole events that a chunk completes; ``kept["tail"]`` holds what is still open.

    Lines end with LF, CR or both; a CR at the end of a chunk waits for its LF.
    """
    tail = kept.get("tail", "")
    if tail.endswith("\r"):
        tail, chunk = tail[:-1], "\r" + chunk
    wait = "\r" if chunk.endswith("\r") and not ended else ""
    lines = chunk.removesuffix(wait).replace("\r\n", "\n").replace("\r", "\n")
    # What is open has no end of an event in it: only what is new is searched.
    whole, fresh = [], "\n\n" in tail[-1:] + lines
    tail += lines
    if fresh:
        *whole, tail = tail.split("\n\n")
    if ended:
        whole, tail = [*whole, tail], ""
    kept["tail"] = tail + wait
    return [event.strip("\n") for event in whole if event.strip()]


def advance(kept: dict, chunk: str, back: dict[str, str], ended: bool = False) -> list[tuple[str | None, int | None, str, str]]:
    """Rows (event, block, kind, text) that a chunk sets free; ``kept`` is changed in place.

    ``kept`` has the open tail, the text held back of each block and the tool input so far. An
    event that does not have the form of its name (no JSON object, an index that is no number,
    a block or delta that is no object) is passed on as it stands.
    """
    texts, tools = kept.setdefault("texts", {}), kept.setdefault("tools", {})
    out: list[tuple[str | None, int | None, str, str]] = []

    def flush(block: str) -> None:
        piece = step(*texts.pop(block), "", back, True)[0]
        if piece:
            out.append(("content_block_delta", int(block), TEXT, piece))

    for raw in split_events(kept, chunk or "", ended):
        found = fields(raw)
        name, body = found.get("event"), body_of(found.get("data"))
        index = body.get("index")
        index = index if isinstance(index, int) and not isinstance(index, bool) and abs(index) < 2**63 else None
        part = body.get("delta" if name == "content_block_delta" else "content_block")
        part = part if isinstance(part, dict) and index is not None else {}
        block, kind = str(index), part.get("type")
        if kind == "text_delta" and isinstance(part.get("text"), str):
            piece, *texts[block] = step(*texts.get(block, ("", "")), part["text"], back, False)
            if piece:
                out.append((name, index, TEXT, piece))
            continue
        if kind == "input_json_delta" and block in tools and isinstance(part.get("partial_json"), str):
            tools[block] += part["partial_json"]
            continue
        if name == "content_block_start" and kind == "tool_use":
            tools[block] = ""
        if name == "content_block_stop" and block in tools:
            out.append(("content_block_delta", index, TOOL, restore_tool_json(tools.pop(block), back)))
        if name == "content_block_stop" and block in texts:
            flush(block)
        kept["stopped"] = kept.get("stopped", False) or name == "message_stop"
        out.append((name, index, PASSED, raw))
    if ended:
        for block in sorted(texts, key=int):
            flush(block)
    return out


def _feed(kept: dict, chunk: str, back: dict[str, str], last: bool) -> tuple[list[tuple], bool]:
    rows = advance(kept, chunk, back, ended=last)
    return rows, last or kept.get("stopped", False)


def _finish(kept: dict, back: dict[str, str]) -> list[tuple]:
    return [*advance(kept, "", back, ended=True), (None, None, LOST, "")]


def restore_events(chunks: DataFrame, idle_ms: int | None = None, arrival: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Restored rows of a stream of raw chunks: ``exchange_id``, ``seq``, ``n``, ``event``, ``block``, ``kind``, ``text``.

    Chunks are taken in order of ``seq``, whatever the order in which they come. Text goes out
    as soon as no surrogate can straddle what is sent, tool input as a whole when its block
    stops. An exchange ends with ``message_stop`` or, with ``idle_ms`` (see
    :func:`ordered.in_order`), by a time-out: it flushes what it holds and ends with a row of
    the kind ``disconnected``.
    """
    return in_order(chunks, _feed, _finish, OUTPUT, idle_ms, arrival, late)


def _in_turn(rows: Iterator[tuple[int, int, str | None, str | None]]) -> Iterator[tuple]:
    """Output rows of chunks (exchange, number, chunk, session) that come exchange by exchange, in order of their numbers."""
    key, seq, session, back, kept = None, None, None, {}, {}

    def ended() -> list[tuple]:
        if key is None or kept.get("stopped"):
            return []
        return [(key, seq + 1, n, *x) for n, x in enumerate(_finish(kept, back))]

    for exchange, number, chunk, given in rows:
        if exchange != key:
            yield from ended()
            key, seq, session, back, kept = exchange, None, None, {}, {}
        elif number == seq:
            continue
        if given is not None and given != session:
            session, back = given, session_of(given)
        seq = number
        yield from ((key, seq, n, *x) for n, x in enumerate(advance(kept, chunk or "", back)))
    yield from ended()


def _restored_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _in_turn(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _SHAPE, strict=True)], schema=_SHAPE)


def restore_events_at_rest(chunks: DataFrame) -> DataFrame:
    """The same for chunks in a table: one pass over them in order; an exchange without ``message_stop`` ends ``disconnected``.

    A chunk without a session goes by that of the chunks before it.
    """
    placed = chunks.where("exchange_id IS NOT NULL AND seq IS NOT NULL")
    placed = placed.select(F.col("exchange_id").cast("long"), F.col("seq").cast("long"), F.col("chunk").cast("string"), F.col("session").cast("string"))
    ordered = placed.repartition("exchange_id").sortWithinPartitions("exchange_id", "seq")
    return ordered.mapInArrow(_restored_batches, OUTPUT)


def streamed_text(rows: DataFrame) -> DataFrame:
    """``exchange_id``, ``block``, ``kind``, ``text``: what each block was sent, put together."""
    sent = rows.where(F.col("kind").isin(TEXT, TOOL)).groupBy("exchange_id", "block", "kind")
    return sent.agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", "n", "text")))["text"], "").alias("text"))


def stream_outcomes(rows: DataFrame, session: DataFrame) -> DataFrame:
    """``exchange_id``, ``outcome``, ``n_unresolved``: the gate at the end of each stream.

    The bytes are out already, so it detects what it cannot prevent: ``blocked`` if a surrogate
    of the exchange stands in what was sent, ``upstream_error`` if the stream broke off, else
    ``forwarded``. ``session`` has ``exchange_id``, ``surrogate``.
    """
    sent = streamed_text(rows).groupBy("exchange_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "text")))["text"], "\0").alias("text"))
    left = rewrite.unresolved(sent, "exchange_id", "text", session).groupBy("exchange_id").agg(F.count("*").alias("n_unresolved"))
    ends = rows.groupBy("exchange_id").agg(F.bool_or(F.col("kind") == LOST).alias("lost"))
    joined = ends.join(left, "exchange_id", "left")
    outcome = F.when(F.col("n_unresolved") > 0, "blocked").when(F.col("lost"), "upstream_error").otherwise("forwarded")
    return joined.select("exchange_id", outcome.alias("outcome"), F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"))

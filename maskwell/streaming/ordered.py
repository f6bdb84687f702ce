"""Chunks of many exchanges, handled in their own order with state and time-outs.

Chunks of an exchange are numbered from 0 and may arrive in any order, over any number of
micro-batches, and more than once. A chunk that comes early waits in state until those before
it are there. An exchange that stays silent too long is given up.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from maskwell.shared import new_path

INPUT = ["exchange_id", "seq", "chunk", "last", "session"]
#: How an exchange stands: chunks still come, it has ended, it was given up.
OPEN, ENDED, LOST = "open", "ended", "disconnected"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: (kept, chunk, session, last) -> rows and whether the exchange ends; ``kept`` is changed in place.
Feed = Callable[[dict, str, dict, bool], tuple[list[tuple], bool]]
#: (kept, session) -> rows of an exchange that breaks off.
Finish = Callable[[dict, dict], list[tuple]]


def session_of(text: Any) -> dict[str, str]:
    """Map surrogate -> real from JSON; anything else counts as an empty map."""
    try:
        found = json.loads(text)
    except (TypeError, ValueError):
        return {}
    return {k: v for k, v in found.items() if isinstance(v, str)} if isinstance(found, dict) else {}


class InOrder(StatefulProcessor):
    """Hands each exchange's chunks to ``feed``, in order and once.

    Output rows are the key, the number of the chunk that set them free, and what ``feed`` or
    ``finish`` give. Without ``idle_ms`` there are no timers, and an exchange that breaks off
    stays open. After its end an exchange is remembered until its timer fires, so that a chunk
    that is sent again opens nothing.
    """

    def __init__(self, feed: Feed, finish: Finish, columns: list[str], idle_ms: int | None, event_time: bool) -> None:
        self._feed, self._finish, self._shape = feed, finish, Row(*columns)
        self._idle, self._event_time = idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._place = handle.getValueState("place", "next long, waiting long, state string, session string, kept string, heard long")
        self._early = handle.getMapState("early", "seq long", "chunk string, last boolean")

    def _now(self, timers: Any) -> int:
        return timers.getCurrentWatermarkInMs() if self._event_time else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Columns that are computed reach the worker without their names: fields go by their place, as in INPUT, then the time.
        arrived: dict[int, Row] = {}
        for r in rows:
            arrived.setdefault(int(r[1]), r)
        numbers = sorted(arrived)
        place = self._place.get()
        at, waiting, state, session, kept, heard = place if place is not None else (0, 0, OPEN, None, "{}", None)
        out: list[tuple] = []
        if self._idle and state == OPEN and heard is not None and self._now(timerValues) >= heard + self._idle:
            # Timers fire after the rows of a batch: this exchange was silent for too long already.
            out, state = self._given_up(key, at, session, kept), LOST
        if state == OPEN:
            if session is None:
                session = next((x for x in (arrived[seq][4] for seq in numbers) if x is not None), None)
            back, held = session_of(session), json.loads(kept)
            come = {seq: (arrived[seq][2] if isinstance(arrived[seq][2], str) else "", bool(arrived[seq][3])) for seq in numbers if seq >= at}
            while state == OPEN and (at in come or (waiting and self._early.containsKey((at,)))):
                if at in come:
                    chunk, last = come.pop(at)
                else:
                    chunk, last = self._early.getValue((at,))
                    self._early.removeKey((at,))
                    waiting -= 1
                found, ended = self._feed(held, chunk, back, last)
                out += [(key[0], at, n, *row) for n, row in enumerate(found)]
                at, state = at + 1, ENDED if ended else OPEN
            for seq, value in come.items():
                if state == OPEN and not (waiting and self._early.containsKey((seq,))):
                    self._early.updateValue((seq,), value)
                    waiting += 1
            kept = json.dumps(held) if state == OPEN else kept
        if self._idle:
            newest = max(int(r[6]) for r in arrived.values()) if self._event_time else self._now(timerValues)
            heard = newest if heard is None else max(heard, newest)
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(max(heard, self._now(timerValues)) + self._idle)
        if state == OPEN:
            self._place.update((at, waiting, state, session, kept, heard))
        else:
            self._close(at, state, waiting)
        yield from map(self._row, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        place, out = self._place.get(), []
        if place is not None and place[2] == OPEN:
            at, waiting, _, session, kept, _ = place
            out = self._given_up(key, at, session, kept)
            self._close(at, LOST, waiting)
            self._handle.registerTimer(self._now(timerValues) + self._idle)
        elif place is not None:
            self._place.clear()
        yield from map(self._row, out)

    def _given_up(self, key: tuple, at: int, session: str | None, kept: str) -> list[tuple]:
        return [(key[0], at, n, *row) for n, row in enumerate(self._finish(json.loads(kept), session_of(session)))]

    def _close(self, at: int, state: str, waiting: int) -> None:
        # Each call to the state is a message to Spark and back.
        if waiting:
            self._early.clear()
        self._place.update((at, 0, state, None, "{}", None))

    def _row(self, values: tuple) -> Row:
        return self._shape(*values)

    def close(self) -> None:
        pass


def in_order(
    chunks: DataFrame, feed: Feed, finish: Finish, output: str, idle_ms: int | None = None, arrival: str | None = None, late: str = "0 seconds"
) -> DataFrame:
    """Stream of ``output`` rows (first ``exchange_id``, ``seq``, ``n``) of a stream of chunks.

    ``chunks`` has ``exchange_id``, ``seq``, ``chunk``, ``session`` and may have ``last``; a
    row without exchange or number has no place and is left out, a null chunk is empty.
    ``idle_ms`` gives an exchange up that was silent for so long: by the clock, or, with the
    timestamp column ``arrival``, by the watermark that trails it by ``late``. By the clock
    Spark asks for one more batch after each, so a query over a source at rest must have no
    ``idle_ms`` or an ``arrival``.
    """
    mode = "None" if idle_ms is None else "EventTime" if arrival else "ProcessingTime"
    placed = chunks.where("exchange_id IS NOT NULL AND seq IS NOT NULL")
    if "last" not in placed.columns:
        placed = placed.withColumn("last", F.lit(False))
    kept = [*INPUT, *([arrival] if mode == "EventTime" else [])]
    placed = placed.select(*kept)
    if mode == "EventTime":
        placed = placed.withWatermark(arrival, late).withColumn("ms", F.unix_millis(F.col(arrival)))
    columns = [c.strip().split(" ")[0] for c in output.split(",")]
    processor = InOrder(feed, finish, columns, idle_ms, mode == "EventTime")
    return placed.groupBy("exchange_id").transformWithState(processor, output, "Append", mode)


def start(stream: DataFrame, out: str, checkpoint: str | None = None, at_rest: bool = True) -> StreamingQuery:
    """Write a stream as Parquet below ``out``; ``at_rest`` ends it when all there is has been read.

    Sets the session's state store to RocksDB, the one that holds maps and timers.
    """
    spark: SparkSession = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint or new_path(spark, "stream-state"))
    return (writer.trigger(availableNow=True) if at_rest else writer).start(out)

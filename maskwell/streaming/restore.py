"""Restoring texts that arrive in chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.functions.words import NAME_SUFFIXES
from maskwell.streaming.ordered import ENDED, LOST, OPEN, in_order

OUTPUT = "exchange_id long, seq long, n long, piece string, state string"


def pattern_of(surrogates: list[str]) -> re.Pattern[str]:
    """Surrogates as whole words, longest first, with a suffix that is carried over."""
    names = "|".join(re.escape(s) for s in sorted(surrogates, key=lambda s: (-len(s), s)))
    return re.compile(rf"(?<!\w)({names})({'|'.join(map(re.escape, NAME_SUFFIXES))})?(?!\w)")


def step(held: str, before: str, chunk: str, back: dict[str, str], last: bool) -> tuple[str, str, str]:
    """(piece that is safe to send, text still held, last character sent before it).

    The end of the text is held back by the longest surrogate and two characters, and the cut
    moves behind any surrogate that straddles it.
    """
    text = held + chunk
    if not back:
        return text, "", before
    cut = len(text) if last else max(0, len(text) - max(map(len, back)) - 2)
    pattern, out, at = pattern_of(list(back)), [], 0
    for m in pattern.finditer(before + text):
        start, end = m.start() - len(before), m.end() - len(before)
        if start >= cut:
            break
        if start < 0:
            continue
        if end > cut and not last:
            # More text could still change how this match ends.
            cut = start
            break
        out += [text[at:start], back[m[1]], m[2] or ""]
        at = end
    cut = max(cut, at)
    out.append(text[at:cut])
    return "".join(out), text[cut:], (before + text[:cut])[-1:]


def _feed(kept: dict, chunk: str, back: dict[str, str], last: bool) -> tuple[list[tuple], bool]:
    piece, kept["held"], kept["before"] = step(kept.get("held", ""), kept.get("before", ""), chunk, back, last)
    return ([(piece, ENDED if last else OPEN)] if piece or last else []), last


def _finish(kept: dict, back: dict[str, str]) -> list[tuple]:
    return [(step(kept.get("held", ""), kept.get("before", ""), "", back, True)[0], LOST)]


def restore_stream(chunks: DataFrame, idle_ms: int | None = None, arrival: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Pieces of restored text for a stream of ``exchange_id``, ``seq``, ``chunk``, ``last``, ``session``.

    ``session`` is the exchange's map surrogate -> real as JSON; one that is no such map
    restores nothing. Chunks are taken in order of ``seq`` from 0 on, whatever the order in
    which they come; a chunk flagged ``last`` flushes its exchange, whose final row has the
    state ``ended``. With ``idle_ms`` (see :func:`ordered.in_order`) an exchange that falls
    silent ends with a row of the state ``disconnected``: what was held back goes out, chunks
    behind a missing one do not, and whatever comes later is ignored.
    """
    return in_order(chunks, _feed, _finish, OUTPUT, idle_ms, arrival, late)


def reassemble(pieces: DataFrame) -> DataFrame:
    """``exchange_id``, ``text`` from pieces or chunks in order of ``seq``."""
    per = pieces.groupBy("exchange_id").agg(F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    return per.select("exchange_id", F.array_join(F.col("p.piece"), "").alias("text"))

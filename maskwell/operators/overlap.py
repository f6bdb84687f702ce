"""Choosing spans without overlap, text by text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def sweep(starts: list[int], ends: list[int]) -> list[int]:
    """Numbers of the spans, given by precedence, that overlap none kept before them.

    Kept spans are disjoint, so their starts and ends are in one order: a span is free if the
    first kept end behind its start belongs to a span that starts no earlier than it ends.
    """
    kept_starts, kept_ends, out = [], [], []
    for k, (s, e) in enumerate(zip(starts, ends, strict=True)):
        at = bisect_left(kept_ends, s + 1)
        if at == len(kept_ends) or kept_starts[at] >= e:
            kept_starts.insert(at, s)
            kept_ends.insert(at, e)
            out.append(k)
    return out


def _settle(key: str, order: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans in order of ``key``, ``s``, ``e``, settled island by island; one island is held between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.RecordBatch | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if open_rows is not None:
                batch = pa.Table.from_batches([open_rows, batch]).combine_chunks().to_batches()[0]
            islands = _islands(batch, key)
            # The last island may go on in the next batch.
            open_rows = batch.slice(int(islands[-1]))
            yield _kept(batch.slice(0, int(islands[-1])), islands, order)
        if open_rows is not None:
            yield _kept(open_rows, np.array([0, open_rows.num_rows]), order)

    return run


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before it."""
    if pa.types.is_struct(column.type):
        # The fields of a null struct count as its own.
        return np.logical_or.reduce([_changes(x) for x in (column.is_null(), *column.flatten())])
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values, values[1:], strict=False)], bool)
    a, b = column[:-1], column[1:]
    same = pc.fill_null(pc.equal(a, b), False)
    return ~pc.or_(same, pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _islands(batch: pa.RecordBatch, key: str) -> np.ndarray:
    """Numbers of the rows with which an island begins: none before them in their text reaches into it."""
    fresh = np.concatenate([[True], _changes(batch[key])])
    s, e = (batch[c].to_numpy().astype(np.int64) for c in ("s", "e"))
    # Texts are laid out one behind the other, so the furthest end so far is that of the own text.
    base = np.cumsum(fresh) << 32
    fresh[1:] |= (s + base)[1:] >= np.maximum.accumulate(e + base)[:-1]
    return np.nonzero(fresh)[0]


def _kept(batch: pa.RecordBatch, islands: np.ndarray, order: list[str]) -> pa.RecordBatch:
    """The chosen spans of islands that begin at the given rows, but for the last number, where the next one begins."""
    sizes = np.diff(islands)
    single = islands[:-1][sizes == 1]
    crowded = np.nonzero(sizes > 1)[0]
    if not len(crowded):
        return batch if len(single) == batch.num_rows else batch.take(pa.array(single, pa.int64()))
    member = np.concatenate([np.arange(islands[k], islands[k + 1]) for k in crowded.tolist()])
    ranks = [_rank(batch[c].take(pa.array(member))) for c in order if c != "_size"]
    s, e = (batch[c].to_numpy()[member].tolist() for c in ("s", "e"))
    ranks.insert(order.index("_size"), [a - b for a, b in zip(s, e, strict=True)])
    keys = list(zip(*ranks, strict=True))
    out, at = [], 0
    for size in sizes[crowded].tolist():
        ranked = sorted(range(at, at + size), key=keys.__getitem__)
        out += [ranked[k] for k in sweep([s[k] for k in ranked], [e[k] for k in ranked])]
        at += size
    return batch.take(pa.array(np.concatenate([single, member[out]]), pa.int64()))


def _rank(column: pa.Array) -> list:
    """Values by which spans of one island are taken; nulls come first."""
    return [(x is not None, x) for x in column.to_pylist()] if column.null_count else column.to_pylist()


def disjoint(found: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows of ``found`` (``key``, ``s``, ``e`` and others) without overlap within a text.

    Greedy by ``order`` (columns, ascending), then the longest, then the leftmost. Spans that
    hang together by overlaps are settled among themselves, by search among the kept ones in
    order of place; most spans stand alone and are passed on as they come. Empty spans go.
    """
    others = [c for c in found.columns if c != key]
    rows = found.where("s < e").select(key, *others)
    placed = rows.repartition(key).sortWithinPartitions(key, "s", "e")
    return placed.mapInArrow(_settle(key, [*(order or []), "_size", *others]), rows.schema)

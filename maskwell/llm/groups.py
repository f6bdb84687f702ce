"""Walking sorted partitions group by group inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Yield one frame per run of equal ``keys`` of a partition sorted by them.

    A run may span Arrow batches; only the run that is still open is held.
    """
    open_parts: list[pd.DataFrame] = []
    open_key = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), dtype=bool)
        change[0] = True
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(batch))
        for start, end in zip(starts, ends, strict=True):
            key = tuple(values[start] for values in columns)
            if open_parts and key != open_key:
                yield pd.concat(open_parts, ignore_index=True)
                open_parts = []
            open_key = key
            open_parts.append(batch.iloc[start:end])
    if open_parts:
        yield pd.concat(open_parts, ignore_index=True)


def whole_groups(
    batches: Iterator[pd.DataFrame], key: str, weigh: Callable[[pd.DataFrame], int], enough: int
) -> Iterator[pd.DataFrame]:
    """Frames of whole runs of equal ``key`` of a partition sorted by it, each of weight ``enough`` or one run more.

    Many small groups come together; a frame holds less than ``enough`` before its last group.
    """
    held: list[pd.DataFrame] = []
    weight, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        for start, end in zip(starts, np.append(starts[1:], len(batch)), strict=True):
            group = batch.iloc[start:end]
            if weight >= enough and values[start] != last:
                yield pd.concat(held, ignore_index=True)
                held, weight = [], 0
            held.append(group)
            weight += weigh(group)
            last = values[start]
    if held:
        yield pd.concat(held, ignore_index=True)


def union_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge the classes of each (left, right) pair; a label is the smallest member index."""
    while len(left):
        a, b = labels[left], labels[right]
        open_pairs = a != b
        if not open_pairs.any():
            break
        left, right, a, b = left[open_pairs], right[open_pairs], a[open_pairs], b[open_pairs]
        low = np.minimum(a, b)
        np.minimum.at(labels, np.maximum(a, b), low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
    return labels

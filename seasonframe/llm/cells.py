"""Streams of sorted rows cut into whole groups, for operators that compare rows inside buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys side by side in one task."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a group ends, with the start of every group (and the length at the end).

    Only the unfinished last group is carried to the next batch, so memory holds a batch and one group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        cut = _starts(table, keys)
        last = int(cut[-2])
        if last:
            yield table.slice(0, last), cut[:-1]
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each of n nodes under the links (i, j): the smallest node it is connected to."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label

"""Rows whose key occurs in at least two records: the counting step behind deduplication of chunks and word runs.

One shuffle and no hot key: every map task first settles the keys it sees in two records of its own, and sends each distinct
key of the task on only once. A key that stands in a third of all rows thus reaches the reducer once per task, not once per
row, and the rows it marks travel by record instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: route, key, rec, at, size; route spreads rows over reducers: the key itself, or the record for rows that are settled.
SCHEMA = "route long, key long, rec long, at int, size int, settled boolean"
OUT = "rec long, at int, size int"
#: Rows a map task holds before it settles and sends them.
FLUSH_ROWS = 2_000_000


def _in_two_records(key: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, group number of each ordered row, and per group whether it has two different records."""
    order = np.lexsort((rec, key))
    k, r = key[order], rec[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    group = np.zeros(len(k), np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    both = np.minimum.reduceat(r, starts) != np.maximum.reduceat(r, starts) if len(starts) else np.empty(0, bool)
    return order, group, both


def settle(key: np.ndarray, rec: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of one flush of a map task: settled rows, and one row of each key for the other tasks.

    Keys seen once in a record travel unsettled with all their rows; a key already known to be shared sends one witness,
    which carries the size 0 and is no row of the result.
    """
    if not len(key):
        return
    order, group, both = _in_two_records(key, rec)
    key, rec, at, size, shared = key[order], rec[order], at[order], size[order], both[group]
    for pick, settled in ((shared, True), (~shared, False)):
        if pick.any():
            route = rec[pick] * np.int64(0x9E3779B1) if settled else key[pick]
            yield _batch(route, key[pick], rec[pick], at[pick], size[pick], settled)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[both]
    if len(starts):
        ends = np.searchsorted(key, key[starts], side="right")
        for r in (rec[starts], rec[ends - 1]):  # rows of a key are in order of record: its least and its greatest differ
            zero = np.zeros(len(r), np.int32)
            yield _batch(key[starts], key[starts], r, zero, zero, False)


def _batch(route: np.ndarray, key: np.ndarray, rec: np.ndarray, at: np.ndarray, size: np.ndarray, settled: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(route), pa.array(key), pa.array(rec), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.full(len(key), settled))],
        names=["route", "key", "rec", "at", "size", "settled"],
    )


class Settler:
    """Collects the rows of a map task and settles them flush by flush."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, key: np.ndarray, rec: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((key, rec, at, size))
        self.rows += len(key)
        if self.rows >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.rows = [], 0
            yield from settle(*columns)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the result in a partition that holds all unsettled rows of its keys, in order of key.

    Held are the rows of a batch and those of the last key before it: a key has rows of one record and two witnesses a flush.
    """
    held: list[np.ndarray] | None = None

    def count(key: np.ndarray, rec: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, group, both = _in_two_records(key, rec)
        pick = order[both[group] & (size[order] > 0)]
        if len(pick):
            yield _out(rec[pick], at[pick], size[pick])

    for b in batches:
        settled = b.column("settled").to_numpy(zero_copy_only=False)
        columns = [b.column(c).to_numpy() for c in ("key", "rec", "at", "size")]
        if settled.any():
            yield _out(*(x[settled] for x in columns[1:]))
        if not settled.all():
            fresh = [x[~settled] for x in columns]
            if held is not None:
                fresh = [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            last = np.searchsorted(fresh[0], fresh[0][-1])
            if last:
                yield from count(*(x[:last] for x in fresh))
            held = [x[last:] for x in fresh]
    if held is not None:
        yield from count(*held)


def _out(rec: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rec), pa.array(at), pa.array(size)], names=["rec", "at", "size"])


def shared_rows(settled: DataFrame) -> DataFrame:
    """(rec, at, size) of all rows whose key stands in two or more records; settled: rows as a Settler makes them (SCHEMA).

    A row may come twice; an empty input gives an empty result.
    """
    return settled.repartition(F.col("route")).sortWithinPartitions("settled", "key").mapInArrow(_reduce, OUT)

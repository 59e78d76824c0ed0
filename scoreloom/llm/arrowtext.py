"""Vectorised text helpers used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once inside a task.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch with about `most` bytes of text each (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows] if batch.num_rows else []
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class Words(NamedTuple):
    codes: np.ndarray  # of every word, an index of `distinct`
    distinct: pa.Array
    bounds: np.ndarray  # words of row i: codes[bounds[i]:bounds[i + 1]]


def words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; null has none."""
    texts = pc.fill_null(texts, "")
    for space in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, space, " ")
    lists = pc.split_pattern(texts, " ")
    values = lists.flatten()
    some = pc.greater(pc.binary_length(values), 0)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    row = row[some.to_numpy(zero_copy_only=False)]
    coded = values.filter(some).dictionary_encode()
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, bounds)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)

"""Whole groups out of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def starts(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Mask of the rows where any of the sorted key columns differs from the row before."""
    n = len(columns[0])
    first = np.zeros(n, dtype=bool)
    if n:
        first[0] = True
        for column in columns:
            first[1:] |= column[1:] != column[:-1]
    return first


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 400_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a group of equal ``keys``; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = np.flatnonzero(starts([whole.column(k).to_numpy() for k in keys]))[-1]
        if last:
            yield whole.slice(0, last)
        rest = whole.slice(last)
        held, count = rest.to_batches(), rest.num_rows
        if not last:
            rows = max(rows, 2 * count)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

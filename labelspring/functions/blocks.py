"""Rows and values of Arrow batches, inside tasks.

Sent to the executors with the functions that use them, so that they need not have this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 20  # entries of arrays that are worked on at once; a longer row is a block of its own


def row_blocks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, end row) of consecutive blocks; ``ends`` are the offsets of the rows' arrays."""
    row, n = 0, len(ends) - 1
    while row < n:
        # bound the working set by entries, not rows: documents vary in length
        stop = min(n, max(row + 1, int(np.searchsorted(ends, ends[row] + BLOCK, "right")) - 1))
        yield row, stop
        row = stop


def rejected(values: np.ndarray, model_type: str) -> np.ndarray:
    """Where ``vectors.violation`` holds, for an array of values."""
    if model_type == "bernoulli":
        return (values != 0) & (values != 1)
    return (values < 0) | np.isnan(values)


def row_values(buckets: pa.Array, counts: pa.Array) -> np.ndarray:
    """The counts that belong to the buckets, in their order; 0 where there is none."""
    values = counts.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    want, have = buckets.value_lengths().to_numpy(), counts.value_lengths().to_numpy()
    if np.array_equal(want, have):
        return values
    place = np.arange(want.sum()) - np.repeat(np.cumsum(want) - want, want)
    at = place + np.repeat(np.cumsum(have) - have, want)
    return np.where(place < np.repeat(have, want), np.append(values, 0)[np.minimum(at, len(values))], 0)

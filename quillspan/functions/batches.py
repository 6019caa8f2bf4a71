"""Arrow batches in parts of bounded size, as Python objects take many times the bytes of Arrow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: bytes of Arrow data that become Python objects at a time. One row is never split.
PART = 1 << 18


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each row, for texts and lists; 8 for anything else."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        values = column.flatten()
        each = max(1, values.nbytes // max(1, len(values)))
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) * each + 8
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
    return np.full(len(column), 8, np.int64)


def bounded(batches: Iterable) -> Iterator:
    """The rows of arrays, or of tuples of arrays, in parts of about PART bytes: slices that copy nothing."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        n = len(columns[0])
        upto = np.cumsum(sum(_sizes(c) for c in columns))
        at = 0
        while at < n:
            done = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + PART, "right")))
            part = tuple(c.slice(at, end - at) for c in columns)
            yield part if isinstance(batch, tuple) else part[0]
            at = end
        if n == 0:
            yield batch

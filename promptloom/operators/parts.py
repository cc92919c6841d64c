"""Arrow batches in parts of bounded size, for Python workers of bounded size.

A batch from Spark has up to 10,000 rows.  Of long arrays or texts these are many MB, and what is made of them in Python
is several times larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of arrays, or bytes of text, worked on at once; a longer row is a part of its own.
ENTRIES = 1 << 18

Batches = Iterator[pa.RecordBatch]


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with sizes of ``most`` together, or of one row."""
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < ends.size:
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + most, side="right")), first + 1)
        yield first, last
        first = last


def in_parts(batches: Batches, most: int | None = None) -> Batches:
    """The batches in runs of rows with no more than ``most`` entries in the arrays of their last column."""
    for batch in batches:
        lengths = pc.fill_null(batch.column(batch.num_columns - 1).value_lengths(), 0)
        for first, last in spans(lengths.to_numpy(zero_copy_only=False), most or ENTRIES):
            yield batch.slice(first, last - first)
        pa.default_memory_pool().release_unused()

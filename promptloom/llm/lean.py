"""Python workers of bounded size, which hand freed memory back.

An Arrow batch from Spark is bounded by rows, 10,000 of them, and by 64 MB.  What is made of it in Python is several times
larger, so text is worked on in parts of a few MB.

A worker is used again by the next task and the next stage.  What Arrow and the C library keep of memory that a batch has
freed (two thirds of a worker's size, measured over the stages of the pipeline) would be missing from whatever runs
beside it, so it goes back to the system while a task runs and when it ends.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Seconds between two times that memory is given back.
PAUSE = 0.5
#: Bytes of text worked on at once; a longer text is a part of its own.
PART = 2 << 20

Batches = Iterator[pa.RecordBatch]


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not the GNU library
        return None


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def parts(batch: pa.RecordBatch, column: int, size: int = PART) -> Batches:
    """The batch in runs of rows with no more than ``size`` bytes in a column."""
    if not (pa.types.is_string(batch.column(column).type) or pa.types.is_large_string(batch.column(column).type)):
        yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + size, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def _paused(batches: Batches, text: int | None) -> Batches:
    last = time.monotonic()
    for batch in batches:
        if text is None or not batch.num_rows:
            yield batch
        else:
            yield from parts(batch, text)
        del batch
        if time.monotonic() - last > PAUSE:
            give_back()
            last = time.monotonic()


def lean(run: Callable[[Batches], Batches], text: int | None = None) -> Callable[[Batches], Batches]:
    """``run``, a function for ``mapInArrow``, giving memory back between the batches it asks for and at its end.

    ``text`` is the number of a text column; then it gets batches in parts of bounded text.
    """

    @wraps(run)
    def kept_lean(batches: Batches) -> Batches:
        yield from run(_paused(batches, text))
        give_back()

    return kept_lean

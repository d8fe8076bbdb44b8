"""Arrow batches in slices, so that a Python worker's memory does not follow the size of a batch."""

from __future__ import annotations

from collections.abc import Iterator


def tidy() -> None:
    """Give memory that is free back to the system: Python workers live on from task to task and would hold on to it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def slices(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches cut into slices of a few rows; memory goes back after each batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        tidy()

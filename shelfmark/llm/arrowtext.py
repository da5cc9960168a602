"""Text columns of Arrow batches as bytes, and row numbering inside map tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of a map function holds at a time.
STEP_BYTES = 2 << 20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(array: pa.Array) -> list[bytes | None]:
    """The strings of an array as UTF-8 bytes."""
    return array.cast(pa.binary()).to_pylist()


def steps(batches: Iterator[pa.RecordBatch], text: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each, so memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * size / max(1, column(batch, text).nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Hands memory that a task no longer needs back to the machine; workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def row_numbers() -> Iterator[int]:
    """Numbers that no other task gives: the partition in the high bits, a counter in the low 33."""
    from pyspark import TaskContext

    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 33
    while True:
        yield at
        at += 1


def signed(values) -> np.ndarray:
    """Unsigned 64-bit integers as the signed ones that Spark stores."""
    return np.asarray(values, dtype=np.uint64).view(np.int64)

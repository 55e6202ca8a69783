"""Small helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole texts of this many rows are handed to Python at once; memory in a task stays near one such slice.
SLICE_BYTES = 8 << 20

_OWN: dict[Hashable, Any] = {}
_GC = gc.get_threshold()


def own(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps for later tasks: one thing at a time, until another one or ``free``."""
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = make()
    return _OWN[key]


def free() -> None:
    """Let go of what an earlier operator's tasks have left in this worker process.

    Worker processes outlive a stage, and with them its tables and the free pages of its largest batch.
    """
    _OWN.clear()
    gc.set_threshold(*_GC)
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, a null as the empty text."""
    return [x or b"" for x in pc.cast(column, pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of ``column`` each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def per_slice(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], column: str, limit: int = SLICE_BYTES
) -> DataFrame:
    """Map slices of Arrow batches; ``make`` is called once in each task and returns the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                yield work(part)

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """Only the columns an operator needs, so that clashing extra columns never meet its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)

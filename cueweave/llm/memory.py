"""Freed memory of Python workers goes back to the executor.

Spark keeps Python workers between tasks, so what one stage's allocators retain
would add to what the next stage needs.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

TEXTS_PER_BATCH = 2000


def small_batches(spark: SparkSession) -> None:
    """Let the session hand at most TEXTS_PER_BATCH rows to a Python worker at once.

    Texts are long, and both the executor and its workers hold a whole batch; results
    do not depend on it.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= TEXTS_PER_BATCH:
        spark.conf.set(setting, TEXTS_PER_BATCH)


def release() -> None:
    """Return unused pages of Arrow's pool and of the C library, where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map function over batches that releases memory when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped

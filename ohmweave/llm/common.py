"""What the operators of this subpackage share, beside tables, stores and components of the core."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..sources.store import broadcast_if_small, forget, join_split, made_of, shared_dir, stored, table

__all__ = ["bounded", "broadcast_if_small", "connected_components", "crc32_of_id", "forget", "freeing", "give_back", "join_split", "made_of", "shared_dir", "smaller_batches", "stored", "table", "tidy"]

BATCH_BYTES = 8 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose texts in `column` have `most` bytes together at most; a longer text goes alone.

    Spark fills a batch up to spark.sql.execution.arrow.maxBytesPerBatch or its row that exceeds it, so what a
    worker holds is bounded by that and the longest text, not by a number of rows.
    """
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def freeing(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """bounded in runs of half the size; what a task has freed goes back to the system at its end."""
    yield from bounded(batches, column, BATCH_BYTES // 2)
    give_back()


def give_back() -> None:
    """Memory that is free goes back to the system: an idle worker, and the task of another operator that gets it next, keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(spark: SparkSession) -> None:
    """Have executors drop the broadcasts of finished joins: Spark's cleaner learns of them only as the driver collects garbage,
    and a driver that needs little memory hardly ever does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def smaller_batches(spark: SparkSession, most: int = BATCH_BYTES // 8):
    """Arrow batches of about `most` bytes at most for what runs inside; the session's own setting is back after it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc32_of_id(id_col: str = "doc_id"):
    """crc32 of the id's decimal text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))

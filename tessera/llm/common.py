"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a task holds in expanded form.
CHUNK_BYTES = 2 << 20
#: Rows of a batch that goes to a Python worker: Spark's own 10,000 would be tens of MB of long texts, held several times.
BATCH_ROWS, _BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a key table, some 100 bytes each, up to which it is broadcast; beyond, a join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(table: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, marked for broadcast while that is bounded."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def short_batches(spark: SparkSession) -> None:
    """Let batches for Python workers have BATCH_ROWS rows, unless the session has a setting of its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def release() -> None:
    """Give memory that a task no longer uses back to the machine; Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches with about ``limit`` bytes of ``text`` each; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]

"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Text bytes that a task turns into Python objects at a time.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_slices(batch: pa.RecordBatch, column: int | str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list]]:
    """(first row, UTF-8 texts or None) of a batch, few megabytes at a time."""
    data = batch.column(column)
    data = data.cast(pa.large_binary())
    start, size, rows = 0, 0, []
    for value in data:
        plain = value.as_py()
        rows.append(plain)
        size += len(plain or b"") + 64
        if size >= limit:
            yield start, rows
            start, size, rows = start + len(rows), 0, []
    if rows:
        yield start, rows


def scan_width(frame: DataFrame) -> int:
    """Partitions for a shuffle of a scanned table: grows with its size, never below the session's setting."""
    setting = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(setting, frame.rdd.getNumPartitions())


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from now on: texts are long, and a task holds whole batches of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later stages and would keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def with_fields(frame: DataFrame, more: str) -> StructType:
    """The schema of a frame with further columns, written as DDL."""
    return StructType(frame.schema.fields + StructType.fromDDL(more).fields)


def free_name(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name

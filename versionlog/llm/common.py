"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.scratch import scratch

#: What separates words: ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
#: Rows that a Python worker turns into objects at a time.
ROWS = 1000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, which bounds what a worker holds as objects.

    At the end of a task what it has freed goes back to the system, as workers live on for other tasks.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2 * ROWS) -> Iterator[None]:
    """Within it, what runs gets Arrow batches of at most ``rows`` rows; for workers that hold much besides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which cuts its lineage.

    Lost executors do not lose it, and what reads it more than once does not compute it again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("parquet.block.size", 32 << 20).parquet(path)  # writers hold a row group each
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    """Number of words of ``text`` (null: 0), without building them."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")

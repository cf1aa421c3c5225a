"""Point, range and prefix reads, and pages of them.

Key predicates are applied before the merge, so they reach the Parquet scan; the tombstone filter
comes after it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from versionlog.operators.merge import snapshot

#: Keys that a multi-get broadcasts at most.
BROADCAST_KEYS = 100_000


def get(log: DataFrame, key: str) -> DataFrame:
    """The live record of ``key``, or no row."""
    return snapshot(log.filter(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame, n_keys: int | None = None) -> DataFrame:
    """Live records of the keys in ``keys(key)``; broadcast only if the caller knows there are few."""
    few = n_keys is not None and n_keys <= BROADCAST_KEYS
    return snapshot(log.join(F.broadcast(keys) if few else keys, "key", "left_semi"))


def range_scan(log: DataFrame, low: str, high: str) -> DataFrame:
    """Live records with low <= key <= high; nothing if low > high."""
    return snapshot(log.filter(F.col("key").between(low, high)))


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    return snapshot(log.filter(F.col("key").startswith(prefix)))


def page(records: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) by key; an invalid page or size, or one past the end, is empty."""
    if number < 1 or size < 1:
        return records.limit(0)
    return records.orderBy("key").offset((number - 1) * size).limit(size)


def iterate(records: DataFrame) -> Iterator[Row]:
    """Records in key order, one partition at a time on the driver; stop by leaving the loop."""
    return records.orderBy("key").toLocalIterator()

"""Put workloads of a given number of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.schema import puts


def cycling_puts(spark: SparkSession, n: int = 100_000, keys: int = 100) -> DataFrame:
    """``n`` puts in turn over ``keys`` keys; the value is the key."""
    key = (F.col("id") % keys).cast("string")
    return puts(spark.range(n), key, key, F.col("id"), F.col("id"))

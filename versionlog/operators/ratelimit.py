"""A token bucket that refills after a quiet interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_bucket(requests: DataFrame, capacity: int, interval: int, key: str = "key", at: str = "t", order: str = "seq") -> DataFrame:
    """``requests`` with ``session`` and ``allowed``.

    The bucket of a key is full again when ``interval`` seconds or more have passed since its last
    request, allowed or not; until then ``capacity`` requests are allowed.  So a bucket's life is a
    session between gaps, and a request is allowed by its number in the session.  One sort by key
    serves both windows.
    """
    w = Window.partitionBy(key).orderBy(at, order)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) >= interval).cast("int"), F.lit(0))
    marked = requests.withColumn("__f", fresh).withColumn("session", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy(key, "session").orderBy(at, order))
    return marked.withColumn("allowed", nth <= capacity).drop("__f")


def rejections(requests: DataFrame, capacity: int, interval: int, key: str = "key", at: str = "t", order: str = "seq") -> DataFrame:
    """``(key, requests, rejected)``."""
    return token_bucket(requests, capacity, interval, key, at, order).groupBy(key).agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(~F.col("allowed"), 1)).alias("rejected"))

"""Row numbers and running sums over a whole table without bringing it into one task.

Rows are bucketed by something that follows the order (an hour, a key prefix).  Totals of buckets are
few, so only they are summed in one task; rows are numbered within their buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, bucket: Column, order: list[str | Column], size: Column | None = None, name: str = "n", bytes_name: str = "start") -> DataFrame:
    """``df`` with the row's number ``name`` from 0 and, given ``size``, the sum ``bytes_name`` of sizes before it.

    ``bucket`` must not decrease along ``order``; rows whose bucket is null come first.
    """
    rows = df.withColumn("__b", F.struct(bucket.alias("b"))).withColumn("__s", F.lit(0).cast("long") if size is None else size.cast("long"))
    totals = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"), F.sum("__s").alias("__t"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__b", F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__sum"))
    within = Window.partitionBy("__b").orderBy(*order)
    out = rows.join(totals, "__b").withColumn(name, F.row_number().over(within) - 1 + F.col("__rows"))
    if size is not None:
        out = out.withColumn(bytes_name, F.col("__sum") + F.sum("__s").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s"))
    return out.drop("__b", "__s", "__rows", "__sum")


def batches(log: DataFrame, size: int, hour: int = 3_600_000_000) -> DataFrame:
    """``log`` with ``batch``: every ``size`` records in (ts, seq) order fill one."""
    return numbered(log, F.floor(F.col("ts") / hour), ["ts", "seq"]).withColumn("batch", F.floor(F.col("n") / size).cast("long")).drop("n")

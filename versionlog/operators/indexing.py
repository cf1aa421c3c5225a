"""Run bounds, pruning, sparse indexes and the key dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versionlog.functions.encoding import index_entry_length, plain_length
from versionlog.operators.numbering import numbered


def bounds(records: DataFrame, run: str = "run") -> DataFrame:
    """``(run, min_key, max_key, records)``."""
    return records.groupBy(run).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("records"))


def may_hold(key: str) -> Column:
    """Runs whose bounds admit the key."""
    return (F.col("min_key") <= key) & (F.col("max_key") >= key)


def may_overlap(low: str, high: str) -> Column:
    return (F.col("min_key") <= high) & (F.col("max_key") >= low)


def may_begin(prefix: str) -> Column:
    """Runs that may hold a key with the prefix."""
    return ~((F.col("max_key") < prefix) | ((F.col("min_key") > prefix) & ~F.col("min_key").startswith(prefix)))


def _every(entries: DataFrame, degree: int, size: Column, run: str) -> DataFrame:
    """Every ``degree``-th entry of a run by key, with the byte offset where it starts."""
    w = Window.partitionBy(run).orderBy("key")
    start = F.coalesce(F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = entries.withColumn("__size", size).withColumn("__i", F.row_number().over(w) - 1).withColumn("offset", start)
    return placed.filter(F.col("__i") % degree == 0).select(run, "key", "offset")


def sparse_index(records: DataFrame, degree: int = 5, run: str = "run") -> DataFrame:
    """``(run, key, offset)``: every ``degree``-th record of a run, and its offset in the run's data."""
    return _every(records, degree, plain_length(F.col("key"), F.col("value"), F.col("tombstone")), run)


def summary_index(records: DataFrame, degree: int = 5, summary_degree: int = 5, run: str = "run") -> DataFrame:
    """The same over the entries of the sparse index."""
    return _every(sparse_index(records, degree, run).select(run, "key"), summary_degree, index_entry_length(F.col("key")), run)


def floor_lookup(index: DataFrame, probes: list[str], run: str = "run") -> DataFrame:
    """``(run, probe, start, end)``: the block that would hold each probe key (end 0: to the end of the run).

    No row for a run that begins after the key.  Runs answer each probe on their own, so a few probes
    are spread over the index rows and combine before the shuffle.
    """
    met = index.withColumn("probe", F.explode(F.array(*map(F.lit, probes))))
    below = F.col("key") <= F.col("probe")
    found = met.groupBy(run, "probe").agg(F.max(F.when(below, F.col("offset"))).alias("start"), F.coalesce(F.min(F.when(~below, F.col("offset"))), F.lit(0)).alias("end"))
    return found.filter(F.col("start").isNotNull())


def dictionary(records: DataFrame, batch: str = "batch") -> DataFrame:
    """``(key, id)``: keys numbered from 0 in the order of their first batch, then by key."""
    firsts = records.groupBy("key").agg(F.min(batch).alias("first"))
    return numbered(firsts, F.col("first"), ["key"], name="id").select("key", "id")


def encode(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids, "key").drop("key")


def decode(encoded: DataFrame, ids: DataFrame) -> DataFrame:
    """Keys of the ids; an id that is not in the dictionary has a null key."""
    return encoded.join(ids, "id", "left")

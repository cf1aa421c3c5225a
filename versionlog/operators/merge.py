"""Latest version wins: merges, snapshots, history.

One aggregation by key keeps the greatest (ts, seq) of each key; it combines before the shuffle, so
each task sends a row per key at most, however often a key was written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, *more_order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The last record of each key, tombstones included; ties go to the greatest ``seq``, then ``more_order``.

    ``within`` names columns (a batch, a run) in which keys are merged apart.
    """
    order = ["ts", "seq", *more_order]
    last = log.groupBy(*within, "key").agg(F.max_by(F.struct("value", "tombstone", *order), F.struct(*order)).alias("r"))
    return last.select(*within, "key", "r.value", "r.ts", "r.seq", "r.tombstone")


def snapshot(log: DataFrame) -> DataFrame:
    """Live records: tombstones are dropped after the merge, so a delete hides what came before it."""
    return latest(log).filter(~F.col("tombstone")).drop("tombstone")


def as_of(log: DataFrame, ts: int) -> DataFrame:
    """The snapshot as it was at ``ts``, inclusive."""
    return snapshot(log.filter(F.col("ts") <= ts))


def deleted_keys(log: DataFrame) -> DataFrame:
    return latest(log).filter("tombstone").select("key", "ts")


def history(log: DataFrame) -> DataFrame:
    """Every version with the time of the next one of its key (null: current)."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    return log.withColumn("version", F.row_number().over(w)).withColumn("valid_to", F.lead("ts").over(w))


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """All records of the runs; ``run`` is the place in the list."""
    return reduce(DataFrame.unionByName, [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)])


def merge_runs(runs: list[DataFrame], keep_tombstones: bool = True) -> DataFrame:
    """One run of the latest records; of equal (ts, seq) the one of the earlier run."""
    every = union_runs(runs).withColumn("__first", -F.col("run"))
    merged = latest(every, "__first")
    return merged if keep_tombstones else merged.filter(~F.col("tombstone"))

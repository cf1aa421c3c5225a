"""Levels of runs: capacity, overlap, and the two ways to compact.

``records`` has (level, run, key, value, ts, seq, tombstone).  A tombstone goes only when its merge
lands on the bottom level and nothing that it hides can be left there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versionlog.operators.merge import latest


def capacity(level: Column, first: int, growth: int, leveled: bool) -> Column:
    """Runs that a level may hold."""
    if not leveled:
        return F.lit(first).cast("long")
    return F.when(level == 0, F.lit(1)).otherwise(F.lit(first) * F.pow(F.lit(growth), level - 1)).cast("long")


def overfull(manifest: DataFrame, first: int, growth: int, leveled: bool, depth: int) -> DataFrame:
    """``(level, runs, capacity)`` of levels that hold more runs than they may; never the last level."""
    held = manifest.groupBy("level").agg(F.count(F.lit(1)).alias("runs")).withColumn("capacity", capacity(F.col("level"), first, growth, leveled))
    return held.filter((F.col("runs") > F.col("capacity")) & (F.col("level") < depth - 1))


def level_bounds(records: DataFrame) -> DataFrame:
    """``(level, run, min_key, max_key, records)``."""
    return records.groupBy("level", "run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("records"))


def overlaps(manifest: DataFrame, level: int) -> DataFrame:
    """``(upper, lower)`` runs of ``level`` and the next that share part of the key range."""
    up = manifest.filter(F.col("level") == level).select(F.col("run").alias("upper"), F.col("min_key").alias("a"), F.col("max_key").alias("b"))
    low = manifest.filter(F.col("level") == level + 1).select(F.col("run").alias("lower"), F.col("min_key").alias("c"), F.col("max_key").alias("d"))
    return up.join(low, (F.col("a") <= F.col("d")) & (F.col("b") >= F.col("c"))).select("upper", "lower")


def misordered(manifest: DataFrame) -> DataFrame:
    """Runs of a level below the first whose range is not wholly before the next run's."""
    after = F.lead("min_key").over(Window.partitionBy("level").orderBy("min_key", "run"))
    return manifest.withColumn("next_min", after).filter((F.col("level") > 0) & (F.col("next_min") <= F.col("max_key"))).select("level", "run", "max_key", "next_min")


def size_tiered(records: DataFrame, level: int, depth: int) -> DataFrame:
    """All runs of ``level`` as one run of the next level.

    Runs that are on the bottom level already are not in the merge, so tombstones go only for keys that these do not hold.
    """
    merged = latest(records.filter(F.col("level") == level))
    if level + 1 == depth - 1:
        below = records.filter(F.col("level") == level + 1).select(F.col("key").alias("held")).distinct()
        kept = merged.filter("tombstone").join(below, F.col("key") == F.col("held"), "left_semi")
        merged = merged.filter("NOT tombstone").unionByName(kept)
    return merged.withColumn("level", F.lit(level + 1))


def leveled(records: DataFrame, level: int, depth: int) -> DataFrame:
    """The first run of ``level`` merged with the runs of the next level that it overlaps.

    With none, the run moves down as it is.  The chosen runs are few, one level of a manifest at most,
    so they are found once and sent to the scan of the records.
    """
    manifest = level_bounds(records.filter(F.col("level").isin(level, level + 1)))
    first = manifest.filter(F.col("level") == level).agg(F.min_by(F.struct("run", "min_key", "max_key"), "run").alias("f")).select("f.*")
    below = manifest.filter(F.col("level") == level + 1).select(F.col("run").alias("r"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    met = first.join(below, (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo")), "left")
    chosen = met.select(F.explode(F.array_compact(F.array("run", "r"))).alias("run")).distinct()
    merged = latest(records.filter(F.col("level").isin(level, level + 1)).join(chosen, "run", "left_semi"))
    merged = merged if level + 1 < depth - 1 else merged.filter(~F.col("tombstone"))
    return merged.withColumn("level", F.lit(level + 1))

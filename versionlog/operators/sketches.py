"""Bloom filter, Count-Min and HyperLogLog in long form, so that building, merging and asking are plain plans.

A filter is the table of its set bits, a Count-Min sketch of its cells, an HLL of its registers.
Merging two sketches is a distinct, a sum, or a maximum by cell, which is also how partial results of
one build combine before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.functions.hashing import fnv1a64, md5_u64, seed, to_signed, trailing_rank


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hash functions) for ``n`` elements at false-positive rate ``p``."""
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def _places(df: DataFrame, key: str, m: int, k: int, row: str, place: str) -> DataFrame:
    """A row per element and hash function: its number and its place modulo ``m``."""
    spread = df.withColumn(row, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return spread.withColumn(place, (md5_u64(F.col(key), seed(F.col(row))) % F.lit(m)).cast("long"))


def bloom_build(df: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """``(bit)``: the set bits."""
    return _places(df.select(key).distinct(), key, m, k, "i", "bit").select("bit").distinct()


def bloom_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def bloom_probe(bits: DataFrame, probes: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """``(key, found)``: whether all bits of the element are set; never false for an element put in."""
    asked = _places(probes.select(key).distinct(), key, m, k, "i", "bit")
    hits = asked.join(bits.withColumn("hit", F.lit(1)), "bit", "left")
    return hits.groupBy(key).agg((F.count("hit") == k).alias("found"))


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    """(columns, rows); one row more than the common bound asks for."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def cms_build(df: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """``(row, col, n)``: cells that are not zero.  Equal elements are counted before they are spread."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return _places(counted, key, m, k, "row", "col").groupBy("row", "col").agg(F.sum("c").alias("n"))


def cms_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("n").alias("n"))


def cms_estimate(cells: DataFrame, probes: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """``(key, estimate)``: the least of the element's cells, never under its count."""
    asked = _places(probes.select(key).distinct(), key, m, k, "row", "col")
    met = asked.join(cells, ["row", "col"], "left")
    return met.groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def hll_build(df: DataFrame, key: str, p: int) -> DataFrame:
    """``(bucket, rank)``: registers that are not zero; the hash's top ``p`` bits choose the bucket."""
    hashed = df.select(key).distinct().select(to_signed(fnv1a64(F.col(key))).alias("h"))
    return hashed.groupBy(F.shiftrightunsigned("h", 64 - p).cast("int").alias("bucket")).agg(F.max(trailing_rank(F.col("h"))).alias("rank"))


def hll_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int) -> DataFrame:
    """``(estimate)``: linear counting for small sets, a correction for those near 2 to 32."""
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    raw: Column = F.lit(alpha * m * m) / (F.sum(F.pow(F.lit(2.0), -F.col("rank"))) + F.lit(m) - F.count(F.lit(1)))
    one = registers.agg(F.count(F.lit(1)).alias("filled"), F.when(F.count(F.lit(1)) == 0, F.lit(alpha * m)).otherwise(raw).alias("e"))
    empty = F.lit(m) - F.col("filled")
    top = float(1 << 32)
    small = (F.col("e") <= 2.5 * m) & (empty > 0)
    big = F.col("e") > top / 30
    return one.select(F.when(small, m * F.log(F.lit(float(m)) / empty)).when(big, -top * F.log(1 - F.col("e") / top)).otherwise(F.col("e")).alias("estimate"))


def approx_distinct(df: DataFrame, key: str, lg_k: int = 12) -> DataFrame:
    """The built-in sketch, for counts that should be near rather than alike."""
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(key, F.lit(lg_k))).alias("estimate"))

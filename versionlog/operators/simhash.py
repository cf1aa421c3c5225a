"""SimHash fingerprints, Hamming distance, and texts within a small distance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.functions.hashing import md5_i64

#: The 64 bits in blocks; texts within 3 bits agree on three of six.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``: bit i is set if words with that bit of their hash weigh more than those without.

    Words are runs between white space of more than two bytes, weighed by their count; a text without
    such words has fingerprint 0.  How often each bit is set is summed two bits to a number, so a text's
    words meet in one aggregation of 32 sums that combines before the shuffle.
    """
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda w: F.octet_length(w) > 2)
    each = docs.select(id_col, F.explode_outer(words).alias("w"))
    hashed = each.withColumn("h", md5_i64(F.col("w")))
    both = F.lit(1 << 32 | 1)
    votes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(both)).alias(f"b{i}") for i in range(32)]
    sums = hashed.groupBy(id_col).agg(F.count("w").alias("n"), *votes)
    value = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"b{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"b{i}", 32)
        for bit, set_ in ((i, low), (i + 32, high)):
            value = value.bitwiseOR(F.when(2 * set_ > F.col("n"), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(id_col, value.alias("fingerprint"))


def halves(fingerprint: Column) -> tuple[Column, Column]:
    """(low, high) 32 bits as nonnegative BIGINTs."""
    return fingerprint.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fingerprint, 32)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near(prints: DataFrame, distance: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``(a, b, distance)`` of different fingerprints within ``distance`` (at most 3), by their least ids, and of members.

    Texts of equal fingerprints are one node; each but the least is paired with that at distance 0.  Two
    fingerprints that differ in three bits differ in three of six blocks at most, so they meet in one
    of the 20 choices of three blocks, each a key of 32 bits or so.
    """
    if distance > 3:
        raise ValueError("blocks of the fingerprint find distances up to 3")
    nodes = prints.groupBy("fingerprint").agg(F.min(id_col).alias("id"))
    parts = [F.shiftrightunsigned("fingerprint", lo).bitwiseAND(F.lit((1 << n) - 1)) for lo, n in BLOCKS]
    keys = [F.xxhash64(F.lit(i), *(parts[k] for k in c)) for i, c in enumerate(combinations(range(6), 3))]
    keyed = nodes.withColumn("key", F.explode(F.array(*keys)))
    a, b = (keyed.select("key", F.col("id").alias(x), F.col("fingerprint").alias(f"f{x}")) for x in "ab")
    met = a.join(b, "key").filter((F.col("a") < F.col("b")) & (hamming(F.col("fa"), F.col("fb")) <= distance))
    pairs = met.select("a", "b", hamming(F.col("fa"), F.col("fb")).alias("distance")).distinct()
    same = prints.join(nodes.withColumnRenamed("id", "a"), "fingerprint").filter(F.col(id_col) != F.col("a"))
    return pairs.unionByName(same.select("a", F.col(id_col).alias("b"), F.lit(0).alias("distance")))

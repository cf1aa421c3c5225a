"""Checksums and Merkle trees of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.functions.hashing import record_crc
from versionlog.operators.numbering import numbered

#: Leaves that one task folds at a time: 2 to this many.
BLOCK_LEVELS = 10


def corrupt(records: DataFrame) -> DataFrame:
    """Records whose stored ``crc`` is not that of key and value."""
    return records.filter(~record_crc(F.col("key"), F.col("value")).eqNullSafe(F.col("crc")))


def merkle_leaves(log: DataFrame, hour: int = 3_600_000_000) -> DataFrame:
    """``(idx, hash)``: SHA-1 of each record as text, in (ts, seq) order."""
    line = F.concat_ws("|", "key", "value", F.col("ts").cast("string"), F.col("tombstone").cast("string"))
    rows = numbered(log, F.floor(F.col("ts") / hour), ["ts", "seq"], name="idx")
    return rows.select("idx", F.sha1(line.cast("binary")).alias("hash"))


def _parent(left: Column, right: Column) -> Column:
    pad = F.sha1(F.lit("").cast("binary"))
    return F.sha1(F.unhex(F.concat(left, F.coalesce(right, pad))))


def next_level(level: DataFrame) -> DataFrame:
    """Parents of a level; a last node without a partner is joined with the pad."""
    side = F.col("idx") % 2
    pairs = level.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(F.max(F.when(side == 0, F.col("hash"))).alias("l"), F.max(F.when(side == 1, F.col("hash"))).alias("r"))
    return pairs.select("idx", _parent(F.col("l"), F.col("r")).alias("hash"))


def merkle_levels(leaves: DataFrame, n: int) -> DataFrame:
    """``(level, idx, hash)`` of the whole tree over ``n`` leaves; a single leaf has a parent too."""
    level, at, out = leaves, 0, leaves.withColumn("level", F.lit(0))
    while n > 1 or at == 0:
        level, at, n = next_level(level), at + 1, -(-n // 2)
        out = out.unionByName(level.withColumn("level", F.lit(at)))
    return out.select("level", "idx", "hash")


def merkle_root(leaves: DataFrame, n: int) -> DataFrame:
    """``(hash)``: the root over ``n`` leaves, folding blocks of 1024 nodes in one aggregation each."""
    if n == 0:
        return leaves.select("hash").limit(0)
    level, first = leaves, True
    while n > 1 or first:
        size = 1 << BLOCK_LEVELS
        blocks = -(-n // size)
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
        level = level.groupBy(F.floor(F.col("idx") / size).alias("idx")).agg(ordered.alias("nodes"))
        # All blocks but the last are full; a last one alone in the tree stops at its root.
        rounds = BLOCK_LEVELS if blocks > 1 else max(1 if first else 0, (n - 1).bit_length())
        for _ in range(rounds):
            half = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("nodes") / 2).cast("int") - 1, F.lit(0)))
            level = level.withColumn("nodes", F.transform(half, lambda i: _parent(F.get("nodes", 2 * i), F.get("nodes", 2 * i + 1))))
        level = level.select("idx", F.col("nodes")[0].alias("hash"))
        n, first = blocks, False
    return level.select("hash")


def merkle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(idx, change)`` of leaves that differ: changed, added (only in ``b``) or removed (only in ``a``)."""
    left, right = a.select("idx", F.col("hash").alias("ha")), b.select("idx", F.col("hash").alias("hb"))
    met = left.join(right, "idx", "full").filter(~F.col("ha").eqNullSafe(F.col("hb")))
    return met.select("idx", F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").otherwise("changed").alias("change"))

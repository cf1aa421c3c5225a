"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node links to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its neighbours below it link to the least of these."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links(u, v)`` but roots themselves; a root is its component's least node.

    Minima merge before the shuffle, and joins with a hot node can be split, so no node's neighbours
    are gathered.  Rounds grow with the logarithm of the longest path; each is written down.
    """
    state = None
    e = stored(links.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "links")
    while True:
        e = stored(_small_star(_large_star(e)), "links")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now

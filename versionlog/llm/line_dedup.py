"""Removal of lines that many sites share.

Per line hash one aggregation merges a HyperLogLog sketch of the sites, and the first place where the
line stands.  Lines whose estimate is clearly above the threshold are boilerplate; lines within the
sketch's error of it are counted exactly.  Only hashes and places are shuffled to find the lines; the
texts are shuffled once, to meet the numbers of their lines to remove.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import GAP, stored

#: Different sites from which a line is boilerplate, and words that such a line has at least.
MIN_SITES, MIN_WORDS = 10, 3
#: Sketch size: 2 to this many registers.
LG_K = 11


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and ``n_lines``, ``n_removed`` added.

    A line is boilerplate if it stands, exactly alike, on at least ``min_sites`` different sites (null
    is a site of its own) and has ``min_words`` words.  With ``keep_first`` the place with the least
    (id, text hash, line number) keeps it, so that no text is lost to the corpus; further copies in
    that document go.  Null texts stay null with 0 lines; an empty text has one empty line.  Rows that
    are equal in id and text are treated alike.  Input columns named like the two new ones, or like
    this function's own (with ``__ld_``), are replaced.
    """
    docs = docs.drop("n_lines", "n_removed").withColumn("__ld_key", F.xxhash64(F.lit(1), id_col, text_col))
    lines = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col("__ld_key").alias("key"),
        F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("z")).alias("site"),
        F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    lines = lines.filter(F.size(F.array_remove(F.split("line", GAP), "")) >= min_words)
    lines = lines.select("id", "key", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(2), "line").alias("g"))
    spread = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sk"), F.min(F.struct("id", "key", "pos")).alias("first"))
    error = 3 * 1.04 / math.sqrt(1 << LG_K)
    spread = stored(spread.filter(F.col("n") >= min_sites).select("h", "g", "first", F.hll_sketch_estimate("sk").alias("sites")).filter(F.col("sites") >= math.floor(min_sites * (1 - error)) - 1), "line-sites")
    high = math.ceil(min_sites * (1 + error)) + 1
    near = spread.filter(F.col("sites") < high)
    exact = lines.join(near.select("h", "g"), ["h", "g"], "left_semi").select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("exact"))
    sure = spread.filter(F.col("sites") >= high).select("h", "g", "first")
    shared = stored(sure.unionByName(near.join(exact.filter(F.col("exact") >= min_sites), ["h", "g"]).select("h", "g", "first")), "shared-lines")
    hits = lines.select("id", "key", "pos", "h", "g").join(shared, ["h", "g"])
    if keep_first:
        hits = hits.filter(~F.struct("id", "key", "pos").eqNullSafe(F.col("first")))
    # Equal rows give each number twice; a document has no more numbers than lines.
    gone = hits.groupBy(F.col("id").alias("__ld_id"), F.col("key").alias("__ld_k")).agg(F.collect_set("pos").alias("__ld_gone"))
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["__ld_id"]) & (docs["__ld_key"] == gone["__ld_k"]), "left")
    split = F.split(text_col, "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains("__ld_gone", i))
    return (
        out.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long"))
        .withColumn("n_removed", F.when(F.col("__ld_gone").isNull(), F.lit(0)).otherwise(F.size("__ld_gone")).cast("long"))
        .withColumn(text_col, F.when(F.col("__ld_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .drop("__ld_key", "__ld_id", "__ld_k", "__ld_gone")
    )

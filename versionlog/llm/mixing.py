"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size within each source.  A source's target is met by whole passes
over all its documents and one part of a pass; that part takes the same share of every size, then a
bounded-knapsack dynamic programme over the sizes left fills what remains of the budget exactly, or
as nearly as the sizes allow.  Which documents of a size are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versionlog.llm.common import n_words, stored

#: Words of the table of the dynamic programme, at least; and with sizes above it, which are few in a budget.
DP_WORDS, LARGE_DP_WORDS = 1 << 15, 1 << 22
#: Rows of a table that may be broadcast (about 10 MB); a larger one is joined by shuffle.
BROADCAST_ROWS = 150_000
#: Documents of one source and size that are ranked together; larger groups are split by hash first.
RANKED = 250


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float = 2.0) -> list[float]:
    """Shares of ``budget`` by weight; none above ``most`` times its size, excess reshared by weight."""
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = float(budget)
    while free and left > 0:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in full]
    return out


def fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many items of each size to take so that their sum is near below ``budget``.

    Proportional first; then the largest sizes that still fit, down to a rest that is twice the
    largest size at least; then bounded knapsack over all sums up to that rest, with counts in binary
    parts.  A budget that is no larger than the rest is filled as well as it can be.
    """
    if budget <= 0 or not any(counts.values()):
        return {}
    if budget >= sum(s * c for s, c in counts.items()):
        return dict(counts)
    counts = {s: c for s, c in counts.items() if 0 < s <= budget}  # no other fits
    total = sum(s * c for s, c in counts.items())
    if budget >= total:
        return counts
    largest = max(counts)
    table = max(DP_WORDS, 2 * largest, LARGE_DP_WORDS if largest > DP_WORDS else 0)
    # Part of the table is held back, so that sizes of all kinds are left to fill with.
    take = {s: c * (budget - table // 2) // total if budget > table else 0 for s, c in counts.items()}
    rest = budget - sum(s * k for s, k in take.items())
    for s in sorted(take, reverse=True):
        if rest <= table:
            break
        more = min(counts[s] - take[s], (rest - table // 2) // s)
        take[s] += max(more, 0)
        rest -= s * max(more, 0)
    parts: list[tuple[int, int]] = []
    for s in sorted(take):
        left, k = min(counts[s] - take[s], rest // s), 1
        while left > 0:
            parts.append((s, min(k, left)))
            left -= min(k, left)
            k *= 2
    # Per sum the part that reached it first; what it was reached from had been reached by earlier parts.
    by = np.full(rest + 1, -1, dtype=np.int32)
    by[0] = len(parts)
    top = 0
    for i, (s, k) in enumerate(parts):
        if by[rest] >= 0:
            break
        n = min(top, rest - s * k) + 1
        if n > 0:
            new = np.flatnonzero((by[:n] >= 0) & (by[s * k : s * k + n] < 0)) + s * k
            by[new] = i
            top = max(top, int(new[-1])) if len(new) else top
    at = top
    while at:
        s, k = parts[by[at]]
        take[s] += k
        at -= s * k
    return {s: k for s, k in take.items() if k}


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if its counted rows stay within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _unit(seed: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52))


def mix(docs: DataFrame, size: Column, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Per document ``(id, size, source_size, target, taken)``.

    Sources, in code point order with null last, have the weights in turn.  ``taken`` is 0, the size,
    or up to ``most`` times it.  A source with no words has target 0.  The driver gets one row per
    source; size counts of one source are filled in one task, and are as many as it has different
    sizes.  Repeated rows count as often as they occur; which of rows with equal ids and sizes are taken
    is arbitrary.  An empty table gives no rows; other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("z"))  # null last
    rows = stored(docs.select(F.col(id_col), key.alias("__s"), F.coalesce(size, F.lit(0)).cast("long").alias("size")), "sizes")
    counts = stored(rows.groupBy("__s", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    sources = sorted(((r["__s"], r["w"] or 0) for r in counts.groupBy("__s").agg(F.sum(F.col("size") * F.col("n")).alias("w")).collect()), key=lambda r: [ord(c) for c in r[0]])
    amounts = [w for _, w in sources]
    aims = dict(zip([s for s, _ in sources], targets(amounts, [weights[i % len(weights)] for i in range(len(sources))], share * sum(amounts), most), strict=True))
    totals = dict(sources)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["__s"].iloc[0]
        whole, part = divmod(round(aims[s]), totals[s]) if totals[s] else (0, 0)
        took = fill(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), part)
        return pdf.assign(k=[took.get(x, 0) for x in pdf["size"].tolist()], whole=whole, source_size=totals[s], target=aims[s])

    picks = stored(counts.groupBy("__s").applyInPandas(plan, "`__s` string, size long, n long, k long, whole long, source_size long, target double"), "picks")
    # A seeded order within (source, size): groups that are taken in part are cut into hash buckets of
    # about RANKED documents; buckets below the boundary are taken whole, only the boundary is ranked.
    part = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED))
    unit = _unit(seed, F.col(id_col))
    placed = rows.join(_small(picks), ["__s", "size"]).withColumn("__u", unit).withColumn("__b", F.when(part, F.floor(F.col("__u") / (F.lit(1 << 52) / buckets))).otherwise(F.lit(-1)).cast("long"))
    split = placed.filter(part).groupBy("__s", "size", "__b").agg(F.count(F.lit(1)).alias("m"), F.first("k").alias("kk"))
    before = F.sum("m").over(Window.partitionBy("__s", "size").orderBy("__b")) - F.col("m")
    room = stored(split.select("__s", "size", "__b", F.least(F.col("m"), F.greatest(F.lit(0), F.col("kk") - before)).alias("room"), "m"), "room")
    placed = placed.join(_small(room), ["__s", "size", "__b"], "left")
    whole_bucket = F.when(F.col("__b") < 0, F.col("k") >= F.col("n")).when(F.col("room") >= F.col("m"), F.lit(True)).when(F.col("room") <= 0, F.lit(False))
    cut = placed.withColumn("__in", whole_bucket & (F.col("k") > 0))
    sure = cut.filter(F.col("__in").isNotNull())
    rank = F.row_number().over(Window.partitionBy("__s", "size", "__b").orderBy("__u", id_col))
    edge = cut.filter(F.col("__in").isNull()).withColumn("__in", rank <= F.col("room"))
    both = sure.unionByName(edge)
    return both.select(id_col, "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("__in").cast("long"))).alias("taken"))


def mix_words(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """``mix`` with sizes in words of ``text_col`` (null: 0)."""
    return mix(docs, n_words(F.col(text_col)), **kw)

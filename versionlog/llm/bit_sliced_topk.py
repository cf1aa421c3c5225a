"""Exact top-k inner products over a bit-sliced index.

Rows of a block are held by attribute and bit: slice (d, i) is a bitmap of the rows whose attribute d,
less its least value in the block, has bit i set.  A query's score for all rows of a block is built
by adding slices with bitmap arithmetic (carry-save adders, the query's weight bits from the highest
down).  The top rows are then chosen from the most significant score slice downward; rows that are
still equal at the boundary are resolved by the smaller id.

Queries and candidates meet block by block, each pair of blocks once: a block of queries is a few
bytes a query, a block of the index at most ``BLOCK_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versionlog.llm.common import stored

BLOCK_ROWS = 16_384
BLOCK_QUERIES = 256
LANES = 64


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, null unless all components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class BitSlicedIndex:
    """Slices of up to some thousands of rows of equal dimension, sorted by id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        n, dim = rows.shape
        self.words = max(1, -(-n // LANES))
        self.low = rows.min(axis=0) if n else np.zeros(dim, dtype=np.int64)
        top = rows.max(axis=0) if n else self.low
        self.bits = [int(int(t) - int(b)).bit_length() for b, t in zip(self.low, top, strict=True)]
        self.slices: list[np.ndarray] = []
        for d in range(dim):
            z = (rows[:, d] - self.low[d]).astype(np.uint64)
            s = np.zeros((self.bits[d], self.words * LANES), dtype=np.uint8)
            for i in range(self.bits[d]):
                s[i, :n] = (z >> np.uint64(i)).astype(np.uint8) & 1
            self.slices.append(np.packbits(s, axis=1, bitorder="little").view(np.uint64).reshape(self.bits[d], self.words))
        self.flipped = [~s for s in self.slices]
        valid = np.zeros(self.words * LANES, dtype=np.uint8)
        valid[:n] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """(slices of a nonnegative score, offset): the inner product is that score plus the offset."""
        weight = [int(q) for q in query]
        # A negative weight takes the complement: -w * z = w * (2^b - 1 - z) - w * (2^b - 1).
        offset = sum(w * int(lo) for w, lo in zip(weight, self.low, strict=True)) + sum(w * ((1 << b) - 1) for w, b in zip(weight, self.bits, strict=True) if w < 0)
        height = max(1, sum(abs(w) * ((1 << b) - 1) for w, b in zip(weight, self.bits, strict=True)).bit_length())
        total = np.zeros((height, self.words), dtype=np.uint64)
        carry = np.zeros_like(total)
        for bit in range(max((abs(w) for w in weight), default=0).bit_length() - 1, -1, -1):
            total[1:], total[0] = total[:-1].copy(), 0
            carry[1:], carry[0] = carry[:-1].copy(), 0
            for d, w in enumerate(weight):
                b = self.bits[d]
                if b and abs(w) >> bit & 1:
                    z = self.slices[d] if w > 0 else self.flipped[d]
                    half = total ^ carry
                    more = total & carry
                    more[:b] |= half[:b] & z
                    half[:b] ^= z
                    total = half
                    carry[1:], carry[0] = more[:-1], 0
        run = np.zeros(self.words, dtype=np.uint64)  # total + carry, rippled once
        for i in range(height):
            a, c = total[i], carry[i]
            half = a ^ c
            total[i], run = half ^ run, (a & c) | (half & run)
        return total, offset

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without rows whose id is ``own``."""
        score, offset = self.scores(query)
        maybe = self.valid.copy()
        if own is not None:
            for i in range(*np.searchsorted(self.ids, [own, own + 1])):
                maybe[i // LANES] &= ~np.uint64(1 << (i % LANES))
        sure = np.zeros_like(maybe)
        need = k
        for i in range(len(score) - 1, -1, -1):
            if need <= 0:
                break
            ahead = maybe & score[i]
            n = int(np.bitwise_count(ahead).sum())
            if n > need:
                maybe = ahead
            else:
                sure |= ahead
                maybe &= ~score[i]
                need -= n
        rows = list(self._places(sure)) + list(self._places(maybe))[: max(need, 0)]
        out = [(sum(1 << i for i in range(len(score)) if int(score[i, r // LANES]) >> (r % LANES) & 1) + offset, int(self.ids[r])) for r in rows]
        return sorted(out, key=lambda x: (-x[0], x[1]))

    @staticmethod
    def _places(bitmap: np.ndarray) -> Iterator[int]:
        for w in np.flatnonzero(bitmap):
            x = int(bitmap[w])
            while x:
                yield int(w) * LANES + (x & -x).bit_length() - 1
                x &= x - 1


    def dump(self) -> dict[str, bytes]:
        return {"ids": self.ids.tobytes(), "low": self.low.astype(np.int64).tobytes(), "bits": bytes(self.bits), "slices": b"".join(x.tobytes() for x in self.slices), "valid": self.valid.tobytes()}

    @classmethod
    def load(cls, ids: bytes, low: bytes, bits: bytes, slices: bytes, valid: bytes) -> BitSlicedIndex:
        self = cls.__new__(cls)
        self.ids, self.low, self.valid = (np.frombuffer(x, dtype=t) for x, t in ((ids, np.int64), (low, np.int64), (valid, np.uint64)))
        self.bits, self.words = list(bits), len(self.valid)
        flat = np.frombuffer(slices, dtype=np.uint64).reshape(sum(self.bits), self.words)
        self.slices = np.split(flat, np.cumsum(self.bits)[:-1]) if self.bits else []
        self.flipped = [~x for x in self.slices]
        return self


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's k best other rows, all if there are fewer.

    Rows with a null id, a null vector, or a null or non-finite component take no part.  Vectors are
    compared with those of equal dimension.  Repeated rows count as often as they occur as candidates,
    and are answered once as queries; a query's own id is no candidate of it.  Empty tables give no
    rows; other columns are not read.
    """
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.coalesce(is_query, F.lit(False)).alias("__q"), quantised(F.col(vector_col), scale).alias("__v"))
    rows = rows.filter(F.col("__v").isNotNull()).groupBy("__id", "__v").agg(F.max("__q").alias("__q"), F.least(F.count(F.lit(1)), F.lit(k).cast("long")).alias("__n"))
    rows = stored(rows.withColumn("__d", F.size("__v")).withColumn("__h", F.xxhash64("__id", "__v")), "vectors")
    sizes = {r["__d"]: (-(-r["n"] // BLOCK_ROWS), max(1, -(-r["q"] // BLOCK_QUERIES))) for r in rows.groupBy("__d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__q").cast("long")).alias("q")).collect()}

    def blocks_of(which: int) -> Column:
        out = F.lit(1)
        for d, n in sizes.items():
            out = F.when(F.col("__d") == d, F.lit(n[which])).otherwise(out)
        return out.cast("long")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        index = BitSlicedIndex(pdf["__id"].to_numpy(dtype=np.int64), np.array(pdf["__v"].tolist(), dtype=np.int64).reshape(len(pdf), -1))
        return pd.DataFrame([{"__d": pdf["__d"].iloc[0], "__cb": pdf["__cb"].iloc[0], **index.dump()}])

    # More than k copies of a row cannot all be among k best; so many are indexed at most.
    dealt = rows.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).withColumn("__cb", F.pmod("__h", blocks_of(0)))
    index = stored(dealt.select("__d", "__cb", "__id", "__v").groupBy("__d", "__cb").applyInPandas(build, "__d int, __cb long, ids binary, low binary, bits binary, slices binary, valid binary"), "bit-slices")
    queries = rows.filter("__q").groupBy("__d", F.pmod(F.shiftright("__h", 20), blocks_of(1)).alias("__qb")).agg(F.collect_list(F.struct(F.col("__id").alias("qid"), F.col("__h").alias("qh"), F.col("__v").alias("qv"))).alias("queries"))
    # Each pair of blocks once: an index block goes to every block of queries of its dimension.
    met = index.withColumn("__qb", F.explode(F.sequence(F.lit(0).cast("long"), blocks_of(1) - 1))).join(queries, ["__d", "__qb"])
    met = met.repartition(max([1, *(a * b for a, b in sizes.values())]), "__d", "__qb", "__cb")

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                block = BitSlicedIndex.load(row.ids, row.low, row.bits, row.slices, row.valid)
                found = [(q["qid"], q["qh"], v, s) for q in row.queries for s, v in block.top(np.asarray(q["qv"], dtype=np.int64), k, q["qid"])]
                yield pd.DataFrame(found, columns=["query_id", "qh", "vec_id", "score"])

    local = met.select("ids", "low", "bits", "slices", "valid", "queries").mapInPandas(search, "query_id long, qh long, vec_id long, score long")
    best = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

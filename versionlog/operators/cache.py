"""What a least-recently-used cache would have hit."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lru_hits(accesses: DataFrame, capacity: int, shard: str = "shard", key: str = "key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``(shard, seq, key, hit)``; each shard is a cache of its own.

    A cache is a state machine over its accesses in order, so rows are sorted within partitions of
    whole shards and stream through; only the ``capacity`` keys of the current shard are held.
    """
    kind = {f.name: f.dataType.simpleString() for f in accesses.schema}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), OrderedDict()
        for b in it:
            hit = []
            for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != now:
                    now, held = s, OrderedDict()
                hit.append(k in held)
                held[k] = None
                held.move_to_end(k)
                if len(held) > capacity:
                    held.popitem(last=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(hit, pa.bool_())], names=["shard", "seq", "key", "hit"])

    sorted_ = accesses.repartition(shard).sortWithinPartitions(shard, *order).select(F.col(shard), F.col(key), F.col(order[-1]))
    return sorted_.mapInArrow(run, f"shard {kind[shard]}, seq {kind[order[-1]]}, key {kind[key]}, hit boolean")

"""The token bucket over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(requests: DataFrame, capacity: int, interval: int) -> DataFrame:
    """``requests(key, t, seq)`` with ``allowed``; state of a key: time of its last request, tokens left.

    Within a micro-batch requests are taken in (t, seq) order; a request older than the last one of an
    earlier batch counts as made at the same time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, left = state.get if state.exists else (None, capacity)
        rows = pd.concat(list(parts)).sort_values(["t", "seq"], kind="stable")
        allowed = []
        for t in rows["t"].tolist():
            if last is not None and t - last >= interval:
                left = capacity
            last = t if last is None else max(t, last)
            allowed.append(left > 0)
            left = max(0, left - 1)
        state.update((int(last), int(left)))
        yield rows.assign(allowed=allowed)[["key", "t", "seq", "allowed"]]

    kind = dict(requests.dtypes)
    out = f"key {kind['key']}, t long, seq long, allowed boolean"
    return requests.select("key", "t", "seq").groupBy("key").applyInPandasWithState(step, out, "last long, left long", "append", GroupStateTimeout.NoTimeout)

"""The admission operator on a stream: the state of each key is its recorded times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evigrain.operators.state import LIMITS, WINDOW_MS, Admission


def admitted_stream(requests: DataFrame, limits: dict[str, int] | None = None, window_ms: int = WINDOW_MS) -> DataFrame:
    """For a stream of (key, kind, at, seq, busy): statuses as in the batch operator, if rows of a key come in order of time."""
    caps = limits or LIMITS

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        key, kind = group
        guard = Admission(caps[kind], window_ms, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = [(key, kind, r.seq, *guard(int(r.at), bool(r.busy))) for r in rows.itertuples(index=False)]
        state.update((list(guard.times),))
        yield pd.DataFrame(out, columns=["key", "kind", "seq", "status", "retry_after"])

    return requests.groupBy("key", "kind").applyInPandasWithState(step, "key long, kind string, seq long, status int, retry_after int", "times array<long>", "append", GroupStateTimeout.NoTimeout)

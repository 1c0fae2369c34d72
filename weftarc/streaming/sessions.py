"""Outcomes of capture sessions over a stream: state for each open session, a timer on event time, nothing kept after it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GRACE_MS = 5000
KINDS = ("result", "navigation", "tab-closed")
OUT = "session_id long, outcome string, at_ms long"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Session(StatefulProcessor):
    """Keeps the earliest event that ends a session until the session's time is over by the watermark."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at_ms long, kind string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.first.get()) if self.first.exists() else None
        ends = None
        for batch in rows:
            ends = int(batch["ends_ms"].iloc[0])
            some = batch[batch["kind"].isin(KINDS) & (batch["at_ms"] < self.limit_ms)]
            for found in zip(some["at_ms"].tolist(), some["kind"].tolist(), strict=True):
                best = found if best is None or found < best else best
        if best is not None:
            self.first.update(best)
        if not self.timer.exists() and ends is not None:
            self.timer.update((ends,))
            self.handle.registerTimer(ends)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at_ms, kind = self.first.get() if self.first.exists() else (self.limit_ms, "timeout")
        self.first.clear()
        self.timer.clear()
        yield pd.DataFrame({"session_id": [key[0]], "outcome": [kind], "at_ms": [at_ms]})

    def close(self) -> None:
        pass


def session_outcomes(events: DataFrame, wait_ms: int, late: str = "10 seconds", grace_ms: int = GRACE_MS) -> DataFrame:
    """session_id, outcome, at_ms of a stream of events, as ``jobs.session_outcomes`` has them of a table.

    ``events``: session_id, started_at, at_ms since then, kind. A session's row comes when the watermark (the latest event less ``late``) has passed
    its start, the wait and the grace; until then events can come in any order, and what comes after is dropped. The session
    must use the state store ROCKS_DB (``spark.sql.streaming.stateStore.providerClass``).
    """
    limit = wait_ms + grace_ms
    start_ms = F.unix_millis("started_at")
    rows = events.select("session_id", F.timestamp_millis(start_ms + F.col("at_ms")).alias("ts"), "at_ms", "kind", (start_ms + limit).alias("ends_ms")).withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(_Session(limit), OUT, "Append", "EventTime")

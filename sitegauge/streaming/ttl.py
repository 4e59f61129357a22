"""Time-to-live hits on a stream: fresh_lookups() of limits.py with state that outlives its batches.

A key is (user_id, event_type). Its state is the time of its last write and the lookups that wait for the watermark, for a lookup can only be judged when no
earlier one can come. An event-time timer stands at the earliest lookup that waits; when the watermark has passed it, all that it has passed are judged in
their order, by time and then event_id: younger than the time to live since the last write is a hit, which leaves the write as it is, anything else is a write. Another timer
stands at the end of the last write's life, and clears it when nothing has come since, so a key that is not asked for again holds no state.

Rows without a time say nothing; rows later than the watermark are dropped by Spark's filter before the state, as in any stream. The state store must be RocksDB's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "user_id long, event_type string, event_id long, ts timestamp, hit boolean"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TimeToLive(StatefulProcessor):
    """Judges the lookups of one key in the order of their times."""

    def __init__(self, days: int):
        self.ttl = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "at long")
        self.waiting = handle.getListState("waiting", "at long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(a), int(e)) for part in rows for a, e in zip(part["at"], part["event_id"], strict=True)]
        held = list(self.waiting.get()) if self.waiting.exists() else []
        first = min(held)[0] if held else None
        self.waiting.appendList(came)
        earliest = min(came)[0]
        if first is None or earliest < first:
            self._ring(earliest)
        yield from self._judged(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judged(key, timerValues.getCurrentWatermarkInMs())

    def _ring(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def _judged(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in held if x[0] // 1000 < watermark]
        written = self.written.get()[0] if self.written.exists() else None
        hits = []
        for at, _ in due:
            hits.append(written is not None and at - written < self.ttl)
            if not hits[-1]:
                written = at
        if due:
            left = held[len(due) :]
            self.waiting.put(left) if left else self.waiting.clear()
            self.written.update((written,))
            self._ring(left[0][0] if left else written + self.ttl)
            yield pd.DataFrame({"user_id": key[0], "event_type": key[1], "event_id": [e for _, e in due], "ts": pd.to_datetime([a for a, _ in due], unit="us"), "hit": hits})
        elif not held and written is not None and (written + self.ttl) // 1000 < watermark:
            self.written.clear()

    def close(self) -> None:
        pass


def stream_lookups(events: DataFrame, days: int = 30, late: str = "10 minutes") -> DataFrame:
    """Every lookup of a stream of events (event_id, ts, user_id, event_type) with whether its cache answers it, once the watermark has passed it."""
    events.sparkSession.conf.set(*STORE)
    rows = events.where("ts is not null").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("user_id", "event_type").transformWithStateInPandas(statefulProcessor=TimeToLive(days), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")

"""Running usage counters and sync heartbeats on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from threadlens.operators.state import ACTIVE_STATUSES, STALE_AFTER_SECONDS
from threadlens.operators.usage import DAY_KEY, usage_daily


def store_usage(events: DataFrame, batch: int, root: str) -> None:
    """The counters of one micro-batch, under its id: a replay writes the same folder."""
    usage_daily(events).write.mode("overwrite").parquet(f"{root}/batch={batch}")


def start_usage(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Count a stream of usage events.

    Every micro-batch stores partial counters, which add up. Nothing is kept in
    memory between batches and an event counts however late it arrives.
    """
    writer = events.writeStream.foreachBatch(lambda rows, batch: store_usage(rows, batch, root))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_counters(spark: SparkSession, root: str) -> DataFrame:
    """The sums of all stored counters."""
    rows = spark.read.parquet(root)
    return rows.groupBy(*DAY_KEY).agg(
        *[F.sum(c).alias(c) for c in ("requests", "input_tokens", "output_tokens", "cache_read_tokens")]
    )


class _Heartbeat(StatefulProcessor):
    """Keeps the last status of a user and reports it stale when it goes silent."""

    def __init__(self, stale_after: int):
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, deadline bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        status = None
        for frame in rows:
            known = frame[frame["key"] == "progress_status"]
            if len(known):
                status = known.sort_values("seq")["value"].iloc[-1]
        if status is None and self.state.exists():
            status = self.state.get()[0]
        status = status or "idle"
        if self.state.exists():
            old = self.state.get()[1]
            if old >= 0:
                self.handle.deleteTimer(old)
        deadline = -1
        if status in ACTIVE_STATUSES:
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.stale_after * 1000
            self.handle.registerTimer(deadline)
        self.state.update((status, deadline))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "stale": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status = self.state.get()[0] if self.state.exists() else "idle"
        self.state.update((status, -1))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "stale": [True]})

    def close(self) -> None:
        pass


def heartbeat_stream(
    state_events: DataFrame, stale_after: int = STALE_AFTER_SECONDS
) -> DataFrame:
    """Status changes, and a stale row when an active user goes silent."""
    return state_events.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Heartbeat(stale_after),
        outputStructType="user_id string, status string, stale boolean",
        outputMode="Update", timeMode="processingTime",
    )

"""Continuous jobs: accepted saves, access statistics, sessions of messages and index refresh, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quarry.sources.files import sessions

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LastAccepted(StatefulProcessor):
    """Of each content hash the time of the last accepted save; a save sooner than `seconds` after it isn't accepted.

    Saves of one batch are taken by time; one that is older than the stored time is a duplicate if it
    lies within the time span on either side. A timer of event time drops the state once the watermark has passed that span:
    whatever may still come is accepted then, so nothing is lost with it.
    """

    def __init__(self, seconds: int = 60) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        saves = pd.concat(list(rows)).sort_values(["ts", "save_id"])
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        keep = []
        for k, at in enumerate(saves["ts"]):
            if last is None or abs((at - last).total_seconds()) >= self.seconds:
                keep.append(k)
                last = at if last is None else max(at, last)
        if keep:
            self.last.update((last.to_pydatetime(),))
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(self._due(last))
        yield saves.iloc[keep][["save_id", "ts", "hash"]]

    def _due(self, last: pd.Timestamp) -> int:
        return int(last.tz_localize("UTC").timestamp() * 1000 if last.tzinfo is None else last.timestamp() * 1000) + self.seconds * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists() and self._due(pd.Timestamp(self.last.get()[0])) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def accepted(saves: DataFrame, seconds: int = 60, late: str = "60 seconds") -> DataFrame:
    """A stream of saves (save_id, ts, content) without duplicates of content within so many seconds.

    Rows later than the watermark (`late` behind the latest time seen) aren't taken; Spark counts them in the query's progress.
    """
    hashed = saves.select("save_id", "ts", F.sha2(F.trim("content"), 256).alias("hash")).withWatermark("ts", late)
    return hashed.groupBy("hash").transformWithStateInPandas(LastAccepted(seconds), "save_id long, ts timestamp, hash string", "append", "eventTime")


def accesses(log: DataFrame) -> DataFrame:
    """A stream of accesses (chunk_id, ts), counted per chunk."""
    return log.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))


def flush_sessions(engine, messages: DataFrame, checkpoint: str, gap: str = "30 minutes", late: str = "10 minutes") -> StreamingQuery:
    """A stream of messages (conv_id, ts, turn, role, text): each session that is over is saved in the engine's index, if its settings flush by themselves."""
    over = sessions(messages, gap, late)
    return over.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: None if rows.isEmpty() else engine.flush_sessions(rows)).start()


def refresh(stream: DataFrame, checkpoint: str, rebuild: Callable[[DataFrame, int], None], seconds: float = 1.5) -> StreamingQuery:
    """Each micro-batch of new or changed files calls `rebuild` (which compares them with the manifest) once."""
    every = f"{max(0.5, seconds)} seconds"
    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def watch(engine, checkpoint: str, seconds: float = 1.5, name: str = "watch") -> StreamingQuery:
    """Every so many seconds (half a one at least) a micro-batch looks at the engine's roots and refreshes the index by what changed.

    Files aren't opened unless their size or time is another one. The index notes the number of the last batch with each version that a batch
    wrote, so a batch that is run again after a kill finds its number and does nothing; a batch that was killed before its version was
    written is done as if for the first time.
    """
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return refresh(ticks, checkpoint, lambda _, batch: engine.refresh(batch=(name, batch)), seconds)

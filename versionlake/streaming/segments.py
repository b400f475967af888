"""Merging of touching vocal segments on a stream."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from versionlake.operators.segments import VOCAL_THRESHOLD

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Segments in one entry of the list state, rows of one output frame, longest segment in seconds.
CHUNK = 10_000
LONGEST = 3600.0


def fold_island(start, end, score, rows: np.ndarray):
    """Fold rows (start, end, score), in time order, onto an open island (start None: none is open).

    Returns the closed islands as an array of rows and the island that stays open.
    """
    closed = []
    for s, e, v in rows.tolist():
        if start is not None and s == end:
            end, score = e, (score + v) / 2
            continue
        if start is not None:
            closed.append((start, end, score))
        start, end, score = s, e, v
    return np.array(closed, "f8").reshape(-1, 3), (start, end, score)


class IslandProcessor(StatefulProcessor):
    """State of a key: the open island, a list of segments in packed chunks that the watermark has not reached, and one timer.

    Input is only appended to the list. The timer stands at the earliest place where something can change: the first
    end in the list, or the last moment at which a segment can still continue the open island. Then the list is read
    once, what the watermark has passed is folded, and the rest, at most what ends within the delay, is put back.
    """

    def __init__(self, key_type, longest: float, chunk: int):
        self.key_type, self.longest, self.chunk = key_type, longest, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows array<double>")
        self.island = handle.getValueState("island", "start double, end double, score double")
        self.timer = handle.getValueState("timer", "at bigint")

    def _chunks(self, rows: np.ndarray) -> list[tuple]:
        return [(rows[i:i + self.chunk].ravel().tolist(),) for i in range(0, len(rows), self.chunk)]

    def _wake(self, at: float) -> None:
        """Move the timer to a time in seconds unless it already stands before it."""
        at, standing = math.ceil(at * 1000), self.timer.get()
        if standing is not None:
            if standing[0] <= at:
                return
            self.handle.deleteTimer(standing[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        first = math.inf
        for batch in rows:
            if len(batch):
                table = batch[["start", "end", "vocalness"]].to_numpy("f8")
                self.waiting.appendList(self._chunks(table))
                first = min(first, float(table[:, 1].min()))
        if first < math.inf:
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        reached = timerValues.getCurrentWatermarkInMs()
        held = [np.array(row[0], "f8").reshape(-1, 3) for row in self.waiting.get()]
        rows = np.concatenate(held) if held else np.empty((0, 3))
        settled = rows[:, 1] * 1000 <= reached
        now, rest = rows[settled], rows[~settled]
        now = now[np.lexsort((now[:, 2], now[:, 1], now[:, 0]))]
        island = self.island.get() or (None, None, None)
        closed, island = fold_island(*island, now)
        if len(now):
            self.waiting.put(self._chunks(rest)) if len(rest) else self.waiting.clear()
        if island[0] is not None and (island[1] + self.longest) * 1000 <= reached \
                and not (rest[:, 0] == island[1]).any():
            closed = np.concatenate([closed, np.array([island], "f8")])
            island = (None, None, None)
        if island[0] is None:
            self.island.clear()
        else:
            self.island.update(tuple(float(x) for x in island))
        ends = ([float(rest[:, 1].min())] if len(rest) else []) + (
            [max(island[1] + self.longest, (reached + 1) / 1000)] if island[0] is not None else [])
        if ends:
            self._wake(min(ends))
        for i in range(0, len(closed), self.chunk):
            part = closed[i:i + self.chunk]
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(part), dtype=self.key_type), "start": part[:, 0],
                                "end": part[:, 1], "vocalness": part[:, 2]})

    def close(self) -> None:
        pass


def merge_vocal_stream(segments: DataFrame, key: str = "md5_encoded", delay: str = "10 minutes",
                       threshold: float = VOCAL_THRESHOLD, longest: float = LONGEST, chunk: int = CHUNK) -> DataFrame:
    """Streaming form of `merge_vocal`: key, start, end, vocalness of closed segments.

    Event time is the end of a segment in seconds. Rows later than the watermark are dropped by Spark, those without key,
    start or end by this function. A merged segment is emitted when a gap follows it, or when the watermark is `longest` seconds
    behind its end: a segment that continued it would be late then, unless it is longer than that. So the stream gives the
    rows of `merge_vocal` over all rows that were in time, provided that segments of a key don't overlap, in whatever
    order they come.

    The state lives in RocksDB, which this kind of operator needs: the session's state store is set to it.
    """
    kind = segments.schema[key].dataType.simpleString()
    segments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    whole = F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    vocal = (segments.where((F.col("vocalness") > threshold) & whole)
             .select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in ("start", "end", "vocalness")])
             .withColumn("_at", F.timestamp_seconds("end")).withWatermark("_at", delay))
    dtype = {"bigint": "int64", "int": "int32"}.get(kind, "object")
    return (vocal.groupBy("key")
            .transformWithStateInPandas(IslandProcessor(dtype, longest, chunk),
                                        f"key {kind}, start double, end double, vocalness double", "Append", "EventTime")
            .withColumnRenamed("key", key))

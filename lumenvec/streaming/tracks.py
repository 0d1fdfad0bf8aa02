"""Tracks of a stream as state of their own (X2, X3, X6), by transformWithState.

A map holds each session's tracks (box, last frame, smoothed vector), another the last vectors of each track in a
ring of slots, a third the sessions (next track's number, last frame). A batch writes each track that its rows join
once, and their slots; other tracks are not touched. Tracks that idle are taken out by the frames that follow, and a
session without rows for idle_ms of event time by a timer, whatever comes in for others.

Sessions of one hash share the maps, with the session in front of their keys: a call for each session would cost far
more than its few rows. So a batch makes as many calls as there are buckets, at most, whatever the number of sessions.

Rows at or before the last frame of an earlier batch of their session are late: they pass through with late set, no
track and no change of state, so that a sink can give them a folder of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StructField, StructType

from .folds import BUCKET, bucket, keys_of, overlap, smooth

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "det_id long, frame long, track int, score double, smoothed array<double>, late boolean"


def _fields(**kinds: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


VECTOR = ArrayType(DoubleType())


class Tracker(StatefulProcessor):
    """The rules of folds.Tracking, over state that the sessions of a bucket share; kind: the key's type."""

    def __init__(self, key: str, kind: DataType, gap: int = 30, idle: int = 60, buffer: int = 20, idle_ms: int | None = None):
        self.key, self.kind, self.gap, self.idle, self.buffer, self.idle_ms = key, kind, gap, idle, buffer, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        number = IntegerType()
        self.tracks = handle.getMapState("tracks", _fields(key=self.kind, track=number), _fields(box=VECTOR, seen=LongType(), n=LongType(), smoothed=VECTOR))
        self.vectors = handle.getMapState("vectors", _fields(key=self.kind, track=number, slot=number), _fields(v=VECTOR))
        self.sessions = handle.getMapState("sessions", _fields(key=self.kind), _fields(next=number, last=LongType(), ms=LongType()))

    def _held(self) -> tuple[dict, dict]:
        """(next track, last frame and latest time by session, tracks by session and number)."""
        sessions = {k[0]: tuple(s) for k, s in self.sessions.iterator()} if self.sessions.exists() else {}
        live: dict = {}
        for (session, track), t in self.tracks.iterator() if self.tracks.exists() else ():
            live.setdefault(session, {})[track] = list(t)
        return sessions, live

    def _forget(self, session: object, track: int, n: int) -> None:
        """Take out a track of n stored rows."""
        for slot in range(min(n, self.buffer)):
            self.vectors.removeKey((session, track, slot))
        self.tracks.removeKey((session, track))

    def _end(self, sessions: dict, live: dict, watermark: int) -> None:
        """Sessions whose last row lies more than idle_ms before the watermark start anew when they come back."""
        for session in [s for s, (_, _, ms) in sessions.items() if ms is not None and ms + self.idle_ms < watermark]:
            for track, t in live.pop(session, {}).items():
                self._forget(session, track, t[2])
            self.sessions.removeKey((session,))
            del sessions[session]

    def _wake(self, sessions: dict, watermark: int) -> None:
        """One timer, for the session that idles first."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due := [ms + self.idle_ms for _, _, ms in sessions.values() if ms is not None]:
            self.handle.registerTimer(max(min(due), watermark + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sessions, live = self._held()
        if self.idle_ms is not None:
            self._end(sessions, live, timerValues.getCurrentWatermarkInMs())  # their timer is due, and would come after these rows
        before, stored = {s: last for s, (_, last, _) in sessions.items()}, {(s, k): t[2] for s, ts in live.items() for k, t in ts.items()}
        held: dict[tuple, list[np.ndarray]] = {}  # the vectors of joined tracks
        slots: dict[tuple, dict[int, np.ndarray]] = {}  # those to be written
        pdf = pd.concat(list(rows)).sort_values(["frame", "det_id"])  # a bucket's rows of one batch
        out, touched = [], set()
        for session, r in zip(keys_of(pdf, self.key, key[0]), pdf.itertuples(index=False), strict=True):
            if before.get(session) is not None and r.frame <= before[session]:
                out.append((session, r.det_id, r.frame, None, None, None, True))
                continue
            v, best, at = np.asarray(r.embedding, np.float64), -1.0, None
            number, _, ms = sessions.get(session, (0, None, None))
            mine = live.setdefault(session, {})
            for k in [k for k, t in mine.items() if r.frame - t[1] > self.idle]:
                if (session, k) in stored:
                    self._forget(session, k, stored[session, k])
                del mine[k]
                held.pop((session, k), None)
                slots.pop((session, k), None)
            for k in sorted(mine):
                box, seen, _, mean = mine[k]
                if r.frame - seen > self.gap:
                    continue
                iou, like = overlap(r.bbox, box), float(v @ np.asarray(mean))
                if iou >= 0.1 and like >= 0.3 and 0.6 * iou + 0.4 * like > best:
                    best, at = 0.6 * iou + 0.4 * like, k
            if best <= 0.3:
                at, best, number = number, 0.0, number + 1
            track, n = (session, at), mine[at][2] if at in mine else 0
            if track not in held:
                held[track] = [np.asarray(self.vectors.getValue((*track, i % self.buffer))[0]) for i in range(max(0, n - self.buffer + 1), n)]
            held[track] = [*held[track], v][-self.buffer :]
            slots.setdefault(track, {})[n % self.buffer] = v
            mean = smooth(held[track])
            mine[at] = [[float(x) for x in r.bbox], int(r.frame), n + 1, mean.tolist()]
            if self.idle_ms is not None:
                ms = max(int(r.ms), ms or 0)
            sessions[session] = (number, int(r.frame), ms)
            touched.add(session)
            out.append((session, r.det_id, r.frame, at, best, mean, False))
        for (session, at), fresh in slots.items():
            self.tracks.updateValue((session, at), tuple(live[session][at]))
            for slot, v in fresh.items():
                self.vectors.updateValue((session, at, slot), (v.tolist(),))
        for session in touched:
            self.sessions.updateValue((session,), sessions[session])
        if self.idle_ms is not None:
            self._wake(sessions, timerValues.getCurrentWatermarkInMs())
        told = pd.DataFrame(out, columns=[self.key, *(c.split()[0] for c in COLUMNS.split(", "))])
        told["track"] = told["track"].astype("Int32")
        yield told

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The state of sessions that idle goes; the next one of the bucket has the timer."""
        sessions, live = self._held()
        self._end(sessions, live, timerValues.getCurrentWatermarkInMs())
        self._wake(sessions, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def tracked(rows: DataFrame, key: str, idle_ms: int | None = None, delay: str = "0 seconds", buckets: int = 4096, **limits: int) -> DataFrame:
    """key, det_id, frame, track, score, smoothed, late of a stream of detections. With idle_ms, rows have an event
    time ts (X6); Spark itself drops rows that are older than the latest ts of earlier batches by more than delay, so
    delay is to cover how far sources may lie apart. A checkpoint holds the number of buckets that it began with."""
    kind = rows.schema[key].dataType.simpleString()
    timed = rows if idle_ms is None else rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)
    processor = Tracker(key, rows.schema[key].dataType, idle_ms=idle_ms, **limits)
    return timed.withColumn(BUCKET, bucket(key, buckets)).groupBy(BUCKET).transformWithStateInPandas(processor, f"{key} {kind}, {COLUMNS}", "Append", "None" if idle_ms is None else "EventTime")


@contextmanager
def state_of_keys(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in a store that reads and writes single keys."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def split_late(out: DataFrame, path: str, late: str):
    """A foreachBatch function's work: a batch's rows to one folder, its late rows to another."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where("not late").drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept.where("late").select(out.columns[0], "det_id", "frame").write.mode("overwrite").parquet(f"{late}/batch={number}")
        kept.unpersist()

    return write

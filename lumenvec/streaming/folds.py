"""Ordered folds over one film's or session's detections (W3, X1-X4) and their batch and streaming forms.

A fold takes rows in frame order and keeps its state in plain attributes, so a batch group and a
stateful stream run the same code. Parallelism is over keys; one key is serial by nature, and its state
is bounded by its groups, tracks and guests. Rows at or before the last frame of an earlier batch of
their key are late: they are dropped and counted.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Grouping:
    """The best group by its running mean vector (over 0, at least threshold), else a new one; a
    face at least duplicate like the group's last kept one is dropped."""

    schema = "det_id long, frame long, group_index int, sim double, kept boolean"

    def __init__(self, threshold: float = 0.6, duplicate: float = 0.95):
        self.threshold, self.duplicate, self.means, self.last = threshold, duplicate, [], []

    def step(self, row: dict) -> tuple:
        v, best, at = row["embedding"], 0.0, None
        if self.means:
            sims = np.stack(self.means) @ v
            k = int(sims.argmax())
            if sims[k] > 0.0:
                best, at = float(sims[k]), k
        if at is None or best < self.threshold:
            at, best = len(self.means), 1.0
            self.means.append(v)
            self.last.append(v)
        elif float(v @ self.last[at]) >= self.duplicate:
            return row["det_id"], row["frame"], at, best, False
        else:
            self.means[at] = 0.9 * self.means[at] + 0.1 * v
            self.last[at] = v
        return row["det_id"], row["frame"], at, best, True


def overlap(a: list[float], b: list[float]) -> float:
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def smooth(buffer: list[np.ndarray]) -> np.ndarray:
    """W5 over a track's buffer."""
    w = np.exp(np.linspace(-3, 0, len(buffer)))
    v = (np.stack(buffer) * (w / w.sum())[:, None]).sum(axis=0)
    return v / (np.linalg.norm(v) or 1.0)


class Tracking:
    """The track with the best 0.6 overlap + 0.4 likeness, of those seen within gap frames, that
    overlap by 0.1 and are alike by 0.3; over 0.3 it takes the face. A track keeps buffer vectors, their smoothed
    vector beside them, and is forgotten after idle frames. tracks.Tracker is the same over a stream's state."""

    schema = "det_id long, frame long, track int, score double, smoothed array<double>"

    def __init__(self, gap: int = 30, idle: int = 60, buffer: int = 20):
        self.gap, self.idle, self.buffer, self.tracks, self.next = gap, idle, buffer, {}, 0

    def step(self, row: dict) -> tuple:
        v, frame = row["embedding"], row["frame"]
        self.tracks = {k: t for k, t in self.tracks.items() if frame - t[1] <= self.idle}
        best, at = -1.0, None
        for k, (box, seen, _, mean) in self.tracks.items():
            if frame - seen > self.gap:
                continue
            iou, like = overlap(row["bbox"], box), float(v @ mean)
            if iou >= 0.1 and like >= 0.3 and 0.6 * iou + 0.4 * like > best:
                best, at = 0.6 * iou + 0.4 * like, k
        if best <= 0.3:
            at, best = self.next, 0.0
            self.next += 1
            self.tracks[at] = (row["bbox"], frame, [], v)
        held = [*self.tracks[at][2], v][-self.buffer :]
        mean = smooth(held)
        self.tracks[at] = (row["bbox"], frame, held, mean)
        return row["det_id"], frame, at, best, mean


class Naming:
    """The known name of a row's best match at or over threshold, else the best guest over 0.65, whose
    vector moves and is made a unit again, else a new guest with score 0. Rows carry name and sim (J8)."""

    schema = "det_id long, frame long, name string, score double"

    def __init__(self, threshold: float = 0.35, guest: float = 0.65):
        self.threshold, self.guest, self.guests = threshold, guest, []

    def step(self, row: dict) -> tuple:
        v = row["embedding"]
        if row["sim"] is not None and row["sim"] >= self.threshold:
            return row["det_id"], row["frame"], row["name"], row["sim"]
        if self.guests:
            sims = np.stack(self.guests) @ v
            k = int(sims.argmax())
            if sims[k] > self.guest:
                moved = 0.9 * self.guests[k] + 0.1 * v
                self.guests[k] = moved / np.linalg.norm(moved)
                return row["det_id"], row["frame"], f"Misafir-{k + 1}", float(sims[k])
        self.guests.append(v)
        return row["det_id"], row["frame"], f"Misafir-{len(self.guests)}", 0.0


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def fold_batch(rows: DataFrame, key: str, make: Callable[[], object]) -> DataFrame:
    """Each key's rows folded in frame order. Rows come to a task sorted and are read as they come: what is held is
    a batch and the state of one key, however many rows the key has."""
    schema = make().schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, now = None, None
        for pdf in parts:
            out = []
            for value, r in zip(pdf[key].tolist(), pdf.assign(embedding=[np.asarray(e, np.float64) for e in pdf["embedding"]]).to_dict("records"), strict=True):
                if fold is None or not (value == now or (pd.isna(value) and pd.isna(now))):
                    fold, now = make(), value
                out.append((value, *fold.step(r)))
            yield pd.DataFrame(out, columns=[key, *_names(schema)])

    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, "frame", "det_id")
    return ordered.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")


#: Column of the number that keys which share a state have in common.
BUCKET = "_bucket"


def bucket(key: str, buckets: int) -> Column:
    """0 to buckets - 1 by a key's hash; -1 for null alone."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")


def keys_of(pdf: pd.DataFrame, key: str, number: int) -> list:
    """A bucket's keys, row after row."""
    return [None] * len(pdf) if number < 0 else pdf[key].tolist()


class _Session:
    """One key's fold within a batch: the last frame of earlier batches, rows that came late, until when it is kept."""

    def __init__(self, fold: object, last: int | None = None, late: int = 0):
        self.fold, self.last, self.late, self.now, self.ms, self.out = fold, last, late, last, None, []

    def take(self, row: dict) -> None:
        if self.last is not None and row["frame"] <= self.last:
            self.late += 1
            return
        self.out.append(self.fold.step(row))
        self.now = int(row["frame"])
        self.ms = max(row["ms"], self.ms or row["ms"]) if "ms" in row else None

    def kept(self) -> bytes:
        return pickle.dumps((self.fold, self.now, self.late))


def fold_stream(rows: DataFrame, key: str, make: Callable[[], object], idle_ms: int | None = None, buckets: int = 4096) -> DataFrame:
    """The same over a stream. A batch's last row of a key tells the late rows dropped so far in late. With idle_ms,
    rows have an event time ts, and the state of a key whose last ts lies more than idle_ms before the watermark
    (the latest ts of all keys) is dropped: the key starts anew (X6).

    Keys of one hash share a state, a table of theirs, as calls for a key each cost far more than its few rows: a batch
    makes buckets calls at most, however many keys it has. Only keys that a batch has rows of are unpacked. A
    checkpoint holds the number of buckets that it began with."""
    schema = make().schema
    kind = rows.schema[key].dataType.simpleString()
    columns = [key, *_names(schema), "late"]

    def run(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[object, tuple[int | None, bytes]] = pickle.loads(state.get[0]) if state.exists else {}
        live: dict[object, _Session] = {}
        if not state.hasTimedOut:
            pdf = pd.concat(list(parts)).sort_values(["frame", "det_id"])
            pdf = pdf.assign(embedding=[np.asarray(e, np.float64) for e in pdf["embedding"]])
            for value, r in zip(keys_of(pdf, key, names[0]), pdf.to_dict("records"), strict=True):
                if value not in live:
                    live[value] = _Session(*pickle.loads(held[value][1])) if value in held else _Session(make())
                live[value].take(r)
        mark = None if idle_ms is None else state.getCurrentWatermarkMs()
        if mark is not None:
            held = {value: k for value, k in held.items() if value in live or k[0] >= mark}
        for value, s in live.items():
            held[value] = (None if mark is None else max((mark if s.ms is None else s.ms) + idle_ms, mark + 1), s.kept())
        if not held:
            state.remove()
        else:
            state.update((pickle.dumps(held),))
            if mark is not None:
                state.setTimeoutTimestamp(max(min(until for until, _ in held.values()), mark + 1))
        yield pd.DataFrame([(value, *row, s.late) for value, s in live.items() for row in s.out], columns=columns)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    timed = rows if idle_ms is None else rows.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", "0 seconds")
    return timed.withColumn(BUCKET, bucket(key, buckets)).groupBy(BUCKET).applyInPandasWithState(run, f"{key} {kind}, {schema}, late long", "state binary", "append", timeout)

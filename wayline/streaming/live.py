"""The same operators over streams: state per key with a time limit, watermarks for late rows, and sinks per micro-batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayline.functions.geometry import in_polygon
from wayline.operators.analytics import area_rules, with_foot
from wayline.operators.tracking import SEEN, TRACKED, TRACKERS, tracked_rows

#: State of a key that brings nothing for so long is dropped.
IDLE_MS = 3_600_000


def read(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100, kind: str = "parquet") -> DataFrame:
    """A folder of files (parquet, json) as a stream; a bounded number of files a batch takes the place of a dropping queue.

    64-bit numbers that telemetry writes as JSON strings are read with a schema of strings and cast.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def _limit(idle_ms: int | None) -> str:
    """Without a limit, a query that is to end when its input does can end: a time limit asks for batches for ever."""
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def tracked(detections: DataFrame, kind: str = "bytetrack", idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Follows boxes through each stream's frames; the tracker is the key's state. A batch's frames are taken in order, later batches come after."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = pickle.loads(state.get[0]) if state.exists else TRACKERS[kind]()
        rows: list[tuple] = []
        for frame, g in pd.concat(list(batches)).sort_values(["frame_id", "det_idx"], kind="stable").groupby("frame_id"):
            rows += tracked_rows(tracker, key[0], frame, g[SEEN].to_numpy(float))
        state.update((pickle.dumps(tracker),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRACKED.split(", ")])

    return detections.groupBy("stream_id").applyInPandasWithState(step, TRACKED, "tracker binary", "append", _limit(idle_ms))


def debounced(candidates: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Crossings (stream_id, rule_id, track_id, direction, ts_ms, gap_ms) that stand at least the gap after the last one let through."""
    keys = ["stream_id", "rule_id", "track_id", "direction"]

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        rows = pd.concat(list(batches)).sort_values("ts_ms")
        for ts, gap in zip(rows["ts_ms"], rows["gap_ms"], strict=True):
            if last is None or ts - last >= gap:
                last = int(ts)
                kept.append((*key, last))
        state.update((last,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(kept, columns=[*keys, "ts_ms"])

    return candidates.groupBy(*keys).applyInPandasWithState(step, "stream_id string, rule_id string, track_id bigint, direction string, ts_ms bigint", "last bigint", "append", _limit(idle_ms))


AREA_EVENTS = "stream_id string, profile string, track_id bigint, rule_id string, kind string, frame_id bigint, ts_ms bigint, foot_x double, foot_y double, dwell_s double, total_dwell_s double"


@dataclass
class Stays:
    """What a stream's areas hold: by (rule, track) when the stay began, whether its threshold has been told, and the seconds of stays that ended."""

    frame: dict[int, list[tuple]] = field(default_factory=dict)
    entered: dict[tuple, int] = field(default_factory=dict)
    told: set[tuple] = field(default_factory=set)
    total: dict[tuple, float] = field(default_factory=dict)

    def exit(self, key: tuple, frame: int, ts: int, x: float, y: float) -> tuple:
        spent = max(0.0, (ts - self.entered.pop(key)) / 1000)
        self.told.discard(key)
        self.total[key] = self.total.get(key, 0.0) + spent
        return (key[1], key[0], "area_exit", frame, ts, x, y, round(spent, 3), round(self.total[key], 3))

    def next_frame(self, frame: int, rows: list[tuple]) -> Iterator[tuple]:
        """Events of a frame's rows (ts_ms, track_id, rule_id, inside, threshold_s, foot_x, foot_y)."""
        ts, here = max(r[0] for r in rows), {r[1] for r in rows}
        for track in [t for t in self.frame if t not in here]:
            for _, _, rule, inside, _, x, y in self.frame[track]:
                if inside:
                    yield self.exit((rule, track), frame, ts, x, y)
        self.frame = {}
        for row in rows:
            at, track, rule, inside, threshold, x, y = row
            self.frame.setdefault(track, []).append(row)
            key = (rule, track)
            if inside and key not in self.entered:
                self.entered[key] = at
                yield (track, rule, "area_enter", frame, at, x, y, None, None)
            elif inside:
                spent = max(0.0, (at - self.entered[key]) / 1000)
                if threshold is not None and spent >= threshold and key not in self.told:
                    self.told.add(key)
                    yield (track, rule, "area_dwell_threshold", frame, at, x, y, round(spent, 3), None)
            elif key in self.entered:
                yield self.exit(key, frame, at, x, y)


def area_events(observations: DataFrame, rules: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Enter, dwell-threshold and exit events of areas, as operators.analytics.area_events gives them; a stream's stays are its key's state.

    A batch's frames are taken in order, later batches come after; the rows of one frame come in one batch.
    """
    seen = with_foot(observations).join(area_rules(rules), ["stream_id", "profile"])
    given = seen.select("stream_id", "profile", "frame_id", "ts_ms", "track_id", "rule_id", in_polygon(F.col("corners"), F.col("foot_x"), F.col("foot_y")).alias("inside"), "threshold_s", "foot_x", "foot_y")

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stays, events = pickle.loads(state.get[0]) if state.exists else Stays(), []
        rows = pd.concat(list(batches)).sort_values(["frame_id", "track_id", "rule_id"], kind="stable")
        for frame, g in rows.groupby("frame_id"):
            plain = zip(g.ts_ms.tolist(), g.track_id.tolist(), g.rule_id, g.inside.tolist(), [None if pd.isna(v) else float(v) for v in g.threshold_s], g.foot_x.tolist(), g.foot_y.tolist(), strict=True)
            events += [(*key, *e) for e in stays.next_frame(int(frame), list(plain))]
        state.update((pickle.dumps(stays),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(events, columns=[c.split()[0] for c in AREA_EVENTS.split(", ")])

    return given.groupBy("stream_id", "profile").applyInPandasWithState(step, AREA_EVENTS, "stays binary", "append", _limit(idle_ms))


def occupancy(observations: DataFrame, width: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Boxes and distinct tracks of each stream in windows of media time; rows later than the watermark are left out."""
    timed = observations.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "stream_id").agg(F.count("*").alias("boxes"), F.approx_count_distinct("track_id").alias("tracks"))


def once(observations: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Each (stream, frame, track) once, as long as its copies come within the watermark."""
    return observations.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late).dropDuplicatesWithinWatermark(["stream_id", "frame_id", "track_id"])


def paired(inference: DataFrame, ui: DataFrame, late: str = "5 seconds") -> DataFrame:
    """Frames of both sides of a stream with equal pts; what finds no other side is forgotten after the watermark."""
    a = inference.withColumn("at", F.timestamp_millis(F.floor(F.col("pts_ns") / 1_000_000))).withWatermark("at", late)
    b = ui.select("stream_id", "pts_ns", F.col("frame_id").alias("ui_frame_id"), F.timestamp_millis(F.floor(F.col("pts_ns") / 1_000_000)).alias("at")).withWatermark("at", late)
    return a.join(b, ["stream_id", "pts_ns", "at"])


def to_tables(folder: str, make: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A sink that derives several tables from a batch and writes each under a folder of the batch's number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, f in make.items():
            f(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return write

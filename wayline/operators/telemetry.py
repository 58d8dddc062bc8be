"""Telemetry events (stream_id, kind, seq, payload): filters, the latest of each key, coalescing, pairing and reordering of frames."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.sequence import SPAN, with_running


def subscribed(events: DataFrame, streams: list[str], frames: bool = True, metrics: bool = True, logs: bool = True) -> DataFrame:
    """What a subscriber asked for: frames of its streams (all, if it names none), metrics, logs; status always."""
    of_stream = F.col("stream_id").isin(streams) if streams else F.lit(True)
    kind = F.col("kind")
    return events.filter((kind == "status") | ((kind == "frame") & F.lit(frames) & of_stream) | ((kind == "metrics") & F.lit(metrics)) | ((kind == "log") & F.lit(logs)))


def to_analyse(events: DataFrame, enabled: bool = True) -> DataFrame:
    """The events that analytics takes: those that hold a frame, while it is switched on."""
    return events.filter(F.lit(enabled) & F.col("frame").isNotNull())


def routed(results: DataFrame, pipes: DataFrame) -> DataFrame:
    """Results beside the pipe of their stream; those of a stream without one are dropped."""
    return results.join(pipes, "stream_id")


def coalesced(events: DataFrame, batch: str, capacity: int) -> DataFrame:
    """A subscriber's queue after each batch: only the newest metrics event stays, and of the rest the newest up to capacity."""
    metrics = events.filter("kind = 'metrics'").groupBy(batch).agg(F.max("seq").alias("seq"))
    rest = events.filter("kind <> 'metrics'").select(batch, "seq")
    kept = metrics.union(rest).withColumn("_n", F.row_number().over(Window.partitionBy(batch).orderBy(F.col("seq").desc())))
    return kept.filter(F.col("_n") <= capacity).drop("_n")


def kept_of_queue(items: DataFrame, keys: list[str], order: str, capacity: int, drop_oldest: bool = True) -> DataFrame:
    """What a full queue holds when nothing is taken: the newest items, or the first ones; with how many were dropped."""
    top = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc() if drop_oldest else F.col(order)))
    kept = items.withColumn("_n", top).filter(F.col("_n") <= capacity).drop("_n")
    counted = items.groupBy(*keys).agg(F.greatest(F.count("*") - capacity, F.lit(0)).alias("dropped"))
    return kept.join(counted, keys)


def paired(inference: DataFrame, ui: DataFrame) -> DataFrame:
    """Frames of two sides of a stream that show the same moment: by equal positive pts, and those without pts by their order.

    Of several frames with one pts each side's first meet, then their second ones; a frame has one partner at most.
    """
    of_moment = F.row_number().over(Window.partitionBy("stream_id", "pts_ns").orderBy("frame_id"))
    timed = lambda side: side.filter("pts_ns > 0").withColumn("_turn", of_moment)
    other = timed(ui).select("stream_id", "pts_ns", "_turn", F.col("frame_id").alias("ui_frame_id"))
    met = timed(inference).join(other, ["stream_id", "pts_ns", "_turn"]).select("stream_id", "frame_id", "ui_frame_id", "pts_ns")
    bare = lambda side: with_running(side.filter("pts_ns <= 0"), ["stream_id"], "frame_id", F.lit(1), "_turn")
    other = bare(ui).select("stream_id", "_turn", F.col("frame_id").alias("ui_frame_id"), F.col("pts_ns").alias("_pts"))
    in_turn = bare(inference).join(other, ["stream_id", "_turn"])
    return met.union(in_turn.select("stream_id", "frame_id", "ui_frame_id", F.when(F.col("pts_ns") > 0, F.col("pts_ns")).otherwise(F.col("_pts"))))


def frames_with_detections(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Every frame with its boxes, an empty list where none came."""
    boxes = detections.groupBy("stream_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", "x", "y", "w", "h", "score"))).alias("boxes"))
    return frames.join(boxes, ["stream_id", "frame_id"], "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)))


def committed(arrivals: DataFrame, window: int = 5, span: int = SPAN) -> DataFrame:
    """Flags frames that arrive after one of more than window ids ahead: they are late. span: of arrival, see operators.sequence."""
    ahead = with_running(arrivals, ["stream_id"], "arrival", F.col("frame_id"), "_ahead", F.max, -1, span)
    return ahead.withColumn("late", F.col("frame_id") < F.col("_ahead") - window).drop("_ahead")


def in_frame_order(arrivals: DataFrame, window: int = 5, most_pending: int = 500) -> DataFrame:
    """Frames as they come out in the order of their ids: (stream_id, frame_id, arrival of the frame that let it out).

    A frame waits for those before it, until one of more than window ids beyond the missing one has come, which is then given up; what
    comes after its turn is dropped. Of more than most_pending waiting frames the first are dropped. What waits at the end stays in.
    """

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turn, newest, waiting = None, 0, 0, []
        for batch in batches:
            rows: list[tuple] = []
            for stream, frame, arrival in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "frame_id", "arrival")), strict=True):
                if stream != now:
                    now, turn, newest, waiting = stream, frame, frame, []
                newest = max(newest, frame)
                if frame < turn:
                    continue
                if frame not in waiting:
                    insort(waiting, frame)
                while waiting and (waiting[0] == turn or newest - turn > window):
                    if waiting[0] == turn:
                        rows.append((stream, waiting.pop(0), arrival))
                        turn += 1
                    else:
                        turn = min(waiting[0], newest - window)
                del waiting[: max(0, len(waiting) - most_pending)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["stream_id", "frame_id", "arrival"])

    given = arrivals.select("stream_id", F.col("frame_id").cast("bigint").alias("frame_id"), F.col("arrival").cast("bigint").alias("arrival"))
    return given.repartition("stream_id").sortWithinPartitions("stream_id", "arrival").mapInArrow(out, "stream_id string, frame_id bigint, arrival bigint")

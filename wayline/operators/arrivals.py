"""Two sequences of arrivals that meet: frames with their detections in the order of frames, and two sides of a stream by their pts.

What comes out depends on all that came before, so a stream's arrivals are read in order; what is held is what waits, within limits.
The small classes are the state of one stream: batch and streaming forms (streaming.live) share them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.tracking import in_order


class Waiting:
    """Numbers that wait, each with the arrival that brought it last, in ascending order."""

    def __init__(self, items: Iterable[tuple[int, int]] = ()):
        self.at = dict(items)
        self.order = sorted(self.at)

    def put(self, number: int, arrival: int) -> None:
        if number not in self.at:
            insort(self.order, number)
        self.at[number] = arrival

    def take(self, number: int) -> int | None:
        arrival = self.at.pop(number, None)
        if arrival is not None:
            del self.order[bisect_left(self.order, number)]
        return arrival

    def trim(self, most: int) -> None:
        for number in self.order[: max(0, len(self.order) - most)]:
            del self.at[number]
        del self.order[: max(0, len(self.order) - most)]


class FramesInTurn:
    """Frames come out in the order of their ids, each with its detections, or without where something more than `window` ids ahead has come.

    A turn whose frame isn't there is given up as soon as a later frame waits. A frame that comes after its turn waits in vain, and while
    it is the first of those that wait no missing turn is given up; detections that come after their turn wait in vain too. Of more than `most` of either kind the lowest go.
    """

    def __init__(self, window: int = 5, most: int = 500, turn: int | None = None, frames: Iterable[tuple[int, int]] = (), boxes: Iterable[tuple[int, int]] = ()):
        self.window, self.most, self.turn, self.frames, self.boxes = window, most, turn, Waiting(frames), Waiting(boxes)

    def push(self, is_frame: bool, number: int, arrival: int) -> Iterator[tuple[int, int, int | None]]:
        """(frame, its arrival, the arrival of its detections or None) of each frame that this lets out."""
        (self.frames if is_frame else self.boxes).put(number, arrival)
        if self.turn is None and self.frames.order:
            self.turn = self.frames.order[0]
        while self.turn is not None:
            if self.turn not in self.frames.at:
                if not self.frames.order or self.frames.order[0] < self.turn:
                    break
                self.turn = self.frames.order[0]
            elif self.turn in self.boxes.at or max([self.frames.order[-1], *self.boxes.order[-1:]]) - self.turn > self.window:
                yield self.turn, self.frames.take(self.turn), self.boxes.take(self.turn)
                self.turn += 1
            else:
                break
        self.frames.trim(self.most)
        self.boxes.trim(self.most)


class Pairing:
    """Frames of two sides that show one moment: the first of the one side whose positive pts the other has too; heads without pts in turn.

    Each side holds `most` frames; a head that can find no partner any more makes way: one whose pts the other side lacks while the other
    head has its partner, or the earlier one.
    """

    def __init__(self, most: int = 8, sides: tuple[Iterable[tuple[int, int]], Iterable[tuple[int, int]]] = ((), ())):
        self.most, self.sides = most, tuple(deque(tuple(x) for x in side) for side in sides)

    def _pair(self) -> tuple[int, int, int] | None:
        one, two = self.sides
        where = {pts: k for k, (pts, _) in reversed(list(enumerate(two)))}
        for i, (pts, frame) in enumerate(one):
            if pts > 0 and pts in where:
                other = two[where[pts]][1]
                del one[i], two[where[pts]]
                return frame, other, pts
        if one and two and one[0][0] <= 0 and two[0][0] <= 0:
            (_, frame), (pts, other) = one.popleft(), two.popleft()
            return frame, other, pts
        return None

    def _evict(self) -> None:
        one, two = self.sides
        for side in self.sides:
            while len(side) > self.most:
                side.popleft()
        while one and two and one[0][0] > 0 and two[0][0] > 0 and one[0][0] != two[0][0]:
            a, b = one[0][0], two[0][0]
            met_a, met_b = any(p == a for p, _ in two), any(p == b for p, _ in one)
            if not met_a and (met_b or a < b):
                one.popleft()
            elif not met_b and (met_a or b < a):
                two.popleft()
            else:
                break

    def push(self, side: int, pts: int, frame: int) -> Iterator[tuple[int, int, int]]:
        """(frame of the first side, of the second, pts) of each pair that this makes."""
        self.sides[side].append((pts, frame))
        for step in (0, 1):
            while (found := self._pair()) is not None:
                yield found
            if step == 0:
                self._evict()


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _in_turn(arrivals: DataFrame, values: list[str], schema: str, state, push) -> DataFrame:
    """Runs a state over each stream's arrivals in order."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            rows: list[tuple] = []
            for stream, *given in zip(*(batch.column(c).to_pylist() for c in ("stream_id", *values)), strict=True):
                if held is None or stream != now:
                    now, held = stream, state()
                rows += [(stream, *out) for out in push(held, *given)]
            yield _table(rows, schema)

    given = arrivals.select("stream_id", *[F.col(c) for c in values])
    return in_order(given, ["stream_id"], "arrival").mapInArrow(work, schema)


FRAMED = "stream_id string, frame_id bigint, arrival bigint, boxes_arrival bigint, out_at bigint"
PAIRED = "stream_id string, frame_id bigint, ui_frame_id bigint, pts_ns bigint"


def frames_in_turn(arrivals: DataFrame, window: int = 5, most: int = 500) -> DataFrame:
    """Arrivals (stream_id, arrival, is_frame, frame_id) to the frames that come out, in turn: FRAMED.

    arrival numbers a stream's arrivals of both kinds; boxes_arrival is null where a frame comes out without detections, out_at is the
    arrival that let it out. What waits at the end stays in.
    """

    def push(held, is_frame, number, arrival):
        return [(*out, arrival) for out in held.push(is_frame, number, arrival)]

    return _in_turn(arrivals, ["is_frame", "frame_id", "arrival"], FRAMED, lambda: FramesInTurn(window, most), push)


def with_boxes(framed: DataFrame, detections: DataFrame) -> DataFrame:
    """Frames in turn with their boxes: those of the detections' arrival that was taken, an empty list where none was."""
    boxes = detections.groupBy("stream_id", F.col("arrival").alias("boxes_arrival")).agg(F.array_sort(F.collect_list(F.struct("det_idx", "x", "y", "w", "h", "score"))).alias("boxes"))
    met = framed.join(boxes, ["stream_id", "boxes_arrival"], "left")
    return met.withColumn("boxes", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)))


def paired_in_turn(arrivals: DataFrame, most: int = 8) -> DataFrame:
    """Arrivals (stream_id, arrival, side 0 or 1, pts_ns, frame_id) to pairs of frames of both sides, with what short queues lose."""

    def push(held, side, pts, frame, _):
        return held.push(side, pts, frame)

    return _in_turn(arrivals, ["side", "pts_ns", "frame_id", "arrival"], PAIRED, lambda: Pairing(most), push)

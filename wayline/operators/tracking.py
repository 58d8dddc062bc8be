"""Operators with state that no window can hold: trackers, optimal assignment, learned routes.

Rows of a stream are brought to one task in order and read as a stream of batches: what is held is the state (a stream's live
tracks, its routes), never the stream. Streams are the unit of parallel work, as every frame depends on the one before.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import partial
from math import hypot

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.geometry import FOOT_SHARE
from wayline.operators.scene_grid import COLS, ROWS


def in_order(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Each key's rows in one partition, in order; as many partitions as shuffles have, since a key's work doesn't show in its bytes, by which adaptive execution would put keys together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The groups of equal keys in sorted batches, whole even where a batch ends inside one: their key and a matrix of their values, null as nan."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        matrix = np.column_stack([batch.column(v).cast(pa.float64()).to_numpy(zero_copy_only=False) for v in values])
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != now:
                yield now, held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            now = key
            held.append(matrix[a:b])
    if held:
        yield now, held[0] if len(held) == 1 else np.concatenate(held)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box (x, y, w, h) in a with every one in b."""
    sizes = np.minimum((a[:, :2] + a[:, 2:])[:, None], b[:, :2] + b[:, 2:])
    sizes -= np.maximum(a[:, None, :2], b[:, :2])
    np.maximum(sizes, 0, out=sizes)
    both = sizes[..., 0] * sizes[..., 1]
    if not both.any():
        return both
    of_a, of_b = np.maximum(a[:, 2:], 0), np.maximum(b[:, 2:], 0)
    either = (of_a[:, 0] * of_a[:, 1])[:, None] + of_b[:, 0] * of_b[:, 1] - both
    return np.divide(both, either, out=np.zeros(both.shape), where=(both > 0) & (either > 0))


def cheapest(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matching of least total cost of a rectangular matrix, as rows in ascending order and their columns: rows join one by one along the shortest alternating path.

    As long as each row's cheapest column is free, that path is one step.
    """
    if cost.shape[0] > cost.shape[1]:
        cols, rows = cheapest(cost.T)
        order = rows.argsort()
        return rows[order], cols[order]
    n, m = cost.shape
    first = cost.argmin(1)
    wanted, taken = first.tolist(), set()
    for begin, j in enumerate(wanted):
        if j in taken:
            break
        taken.add(j)
    else:
        return np.arange(n), first
    price, owner = np.zeros(m), np.full(m, -1)
    gain = np.zeros(n)
    owner[first[:begin]], gain[:begin] = np.arange(begin), cost[np.arange(begin), first[:begin]]
    for row in range(begin, n):
        reach, parent, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, far, via = row, 0.0, -1
        while True:
            way = far + cost[at] - gain[at] - price
            better = ~done & (way < reach)
            reach[better], parent[better] = way[better], via
            via = int(np.where(done, np.inf, reach).argmin())
            far = reach[via]
            done[via] = True
            if owner[via] < 0:
                break
            at = owner[via]
        gain[row] += far
        some = done.nonzero()[0]
        back = far - reach[some]
        price[some] -= back
        held = owner[some] >= 0
        gain[owner[some[held]]] += back[held]
        while via >= 0:
            before = parent[via]
            owner[via] = owner[before] if before >= 0 else row
            via = before
    cols = (owner >= 0).nonzero()[0]
    rows = owner[cols]
    order = rows.argsort()
    return rows[order], cols[order]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of the matching of least total cost."""
    rows, cols = cheapest(cost)
    return list(zip(rows.tolist(), cols.tolist(), strict=True))


def matched(cost: np.ndarray, iou: np.ndarray, least: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """The assignment's pairs that overlap enough, and what is left of rows and columns. Overlap gates, cost never does."""
    pairs = [(i, j) for i, j in assign(cost) if iou[i, j] >= min(max(least, 0.0), 0.999)] if cost.size else []
    rows, cols = {i for i, _ in pairs}, {j for _, j in pairs}
    return pairs, [i for i in range(cost.shape[0]) if i not in rows], [j for j in range(cost.shape[1]) if j not in cols]


ASSIGNED = "stream_id string, frame_id bigint, track_idx int, det_idx int, iou double"


def assigned(pairs: DataFrame, least: float) -> DataFrame:
    """Optimal one-to-one matches of each frame's pairs (track_idx, det_idx, iou, cost); pairs that aren't there cost 1."""

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (stream, frame), g in runs(batches, ["stream_id", "frame_id"], ["track_idx", "det_idx", "iou", "cost"]):
            tracks, i = np.unique(g[:, 0], return_inverse=True)
            dets, j = np.unique(g[:, 1], return_inverse=True)
            cost, iou = np.ones((len(tracks), len(dets))), np.zeros((len(tracks), len(dets)))
            cost[i, j], iou[i, j] = g[:, 3], g[:, 2]
            out += [(stream, int(frame), int(tracks[a]), int(dets[b]), float(iou[a, b])) for a, b in matched(cost, iou, least)[0]]
            if len(out) > 10_000:
                yield _batch(out, ASSIGNED)
                out = []
        yield _batch(out, ASSIGNED)

    return in_order(pairs, ["stream_id", "frame_id"], "track_idx", "det_idx").mapInArrow(solve, ASSIGNED)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of plain values as a batch of a schema of plain types."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


#: Weights of a box's height in the motion model's uncertainty of place and speed; fixed values.
PLACE, SPEED = 1 / 20, 1 / 160
#: Variances that the aspect has instead: of its place and speed in a frame, and of a detection's.
_ASPECT, _ASPECT_SEEN = (1e-2**2, 1e-5**2), 1e-1**2


def to_centre(box: list[float]) -> tuple[float, float, float, float]:
    """(x, y, w, h) to centre, aspect and height; sizes are a pixel at least."""
    x, y, w, h = box
    w, h = max(w, 1.0), max(h, 1.0)
    return x + w / 2, y + h / 2, w / h, h


@dataclass(slots=True)
class Moving:
    """A track with constant velocity under noise that grows with its height.

    mean holds place and speed of centre, aspect and height. Neither noise nor motion ties these four to each other, so that spread holds, for each,
    its variance of place, covariance of place and speed, and variance of speed. Plain numbers: a frame has too few tracks for arrays to pay.
    """

    id: int
    box: list[float]
    score: float
    start: int
    seen: int
    lost: bool
    mean: list[tuple[float, float]]
    spread: list[tuple[float, float, float]]

    @classmethod
    def begin(cls, number: int, box: list[float], score: float, frame: int) -> Moving:
        centre = to_centre(box)
        by_height = ((2 * PLACE * centre[3]) ** 2, 0.0, (10 * SPEED * centre[3]) ** 2)
        return cls(number, box, score, frame, frame, False, [(v, 0.0) for v in centre], [by_height, by_height, (_ASPECT[0], 0.0, _ASPECT[1]), by_height])

    def predict(self) -> None:
        if self.lost:
            self.mean = [(at, 0.0) for at, _ in self.mean]
        h = max(self.mean[3][0], 1.0)
        by_height = (PLACE * h) ** 2, (SPEED * h) ** 2
        self.mean = [(at + speed, speed) for at, speed in self.mean]
        self.spread = [(p + c + (c + v) + place, c + v, v + pace) for (p, c, v), (place, pace) in zip(self.spread, (by_height, by_height, _ASPECT, by_height))]
        self.show()

    def update(self, box: list[float], score: float, frame: int) -> None:
        """Brings the track to what was detected."""
        by_height = (PLACE * max(self.mean[3][0], 1.0)) ** 2
        mean, spread = [], []
        for (at, speed), (p, c, v), found, noise in zip(self.mean, self.spread, to_centre(box), (by_height, by_height, _ASPECT_SEEN, by_height)):
            gain, off = p / (p + noise), found - at
            pull = c / (p + noise)
            mean.append((at + gain * off, speed + pull * off))
            spread.append((p - gain * p, c - gain * c, v - pull * c))
        self.mean, self.spread = mean, spread
        self.score, self.seen, self.lost = score, frame, False
        self.show()

    def show(self) -> None:
        (x, _), (y, _), (aspect, _), (h, _) = self.mean
        h = max(h, 1.0)
        w = max(aspect * h, 1.0)
        self.box = [x - w / 2, y - h / 2, w, h]


def touching(a: list[list[float]], b: list[list[float]]) -> list[tuple[int, int, float]]:
    """The pairs of boxes of a and b that overlap, with their IoU; all have a size."""
    out, bounds = [], [(x, y, x + w, y + h, w * h) for x, y, w, h in b]
    for i, (x, y, w, h) in enumerate(a):
        right, bottom = x + w, y + h
        for j, (left, top, end, under, area) in enumerate(bounds):
            if left < right and x < end and top < bottom and y < under:
                both = (min(right, end) - max(x, left)) * (min(bottom, under) - max(y, top))
                either = w * h + area - both
                if both > 0 and either > 0:
                    out.append((i, j, both / either))
    return out


@dataclass
class SceneGrid:
    """A stream's cells, how much tracks use them and move between them, and what that adds to the cost of a match.

    Counts lose a share each frame. Within warmup frames nothing is added, and in a frame without area nothing is added or counted.
    """

    rows: int = ROWS
    cols: int = COLS
    weight: float = 0.15
    far: float = 0.65
    rare: float = 0.15
    odd: float = 0.2
    most: float = 0.3
    used_decay: float = 0.92
    moved_decay: float = 0.98
    warmup: int = 5
    frames: int = field(default=0, init=False)
    used: np.ndarray = field(init=False)
    moved: np.ndarray = field(init=False)
    away: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = self.rows * self.cols
        self.used, self.moved = np.zeros(n), np.zeros((n, n))
        row, col = np.divmod(np.arange(n), self.cols)
        self.away = self.far * np.minimum(np.hypot(row - row[:, None], col - col[:, None]) / max(1.0, np.hypot(self.rows - 1, self.cols - 1)), 1)

    def begin_frame(self) -> None:
        self.frames += 1
        self.used *= self.used_decay
        self.moved *= self.moved_decay

    def cells(self, boxes: np.ndarray, width: int, height: int) -> np.ndarray:
        at = boxes[:, :2] + boxes[:, 2:] * (0.5, FOOT_SHARE)
        np.maximum(at, 0, out=at)
        np.minimum(at, (width - 1, height - 1), out=at)
        at /= (width, height)
        at *= (self.cols, self.rows)
        cell = np.minimum(at.astype(int), (self.cols - 1, self.rows - 1))
        return cell[:, 1] * self.cols + cell[:, 0]

    def cell(self, box: list[float], width: int, height: int) -> int:
        x, y, w, h = box
        row = min(int(min(max(y + h * FOOT_SHARE, 0), height - 1) / height * self.rows), self.rows - 1)
        return row * self.cols + min(int(min(max(x + w / 2, 0), width - 1) / width * self.cols), self.cols - 1)

    def observe(self, cell: int, before: int | None = None) -> None:
        """Counts a box by its cell, and the way to it from where its track was expected."""
        self.used[cell] += 1
        if before is not None:
            self.moved[before, cell] += 1

    def cost(self, a: np.ndarray, b: np.ndarray) -> np.ndarray | float:
        """What a way from each of the cells a to each of the cells b adds."""
        if self.frames < self.warmup:
            return 0.0
        top, from_a = self.used.max(), self.moved[a]
        ways = from_a.sum(1)[:, None]
        share = self.used[b] / top if top > 0 else 0.0
        chance = from_a[:, b] / np.where(ways > 0, ways, 1)
        raw = self.away[a][:, b] + self.rare * (1 - share) + self.odd * (1 - chance)
        return np.minimum(np.maximum(self.weight * raw, 0), self.most)

    def extra_cost(self, tracks: np.ndarray, dets: np.ndarray, width: int, height: int) -> np.ndarray | float:
        return self.cost(self.cells(tracks, width, height), self.cells(dets, width, height)) if width > 0 and height > 0 else 0.0


@dataclass
class ByteTracker:
    """Two rounds of matching: sure detections with all tracks, unsure ones with the tracks that are left and were seen in the last frame.

    The grid adds to the cost of a match in both rounds; without it (None), or in frames without area, overlap and score decide alone,
    and without fuse_score overlap alone. Thresholds are held within their ranges. The defaults are fixed values.
    """

    high: float = 0.45
    low: float = 0.2
    new: float = 0.45
    iou: float = 0.35
    low_iou: float = 0.25
    duplicate_iou: float = 0.85
    buffer: int = 100
    least_area: float = 0.0
    grid: SceneGrid | None = field(default_factory=SceneGrid)
    fuse_score: bool = True
    tracks: list[Moving] = field(default_factory=list)
    frame: int = 0
    next_id: int = 1

    def __post_init__(self) -> None:
        """Takes the grid's settings with counts of its own."""
        self.grid = self.grid and replace(self.grid)
        held = lambda v, least, most: min(max(v, least), most)
        self.high = held(self.high, 0.01, 0.99)
        self.low, self.new = held(self.low, 0.0, self.high), held(self.new, self.high, 0.999)
        self.iou, self.low_iou, self.duplicate_iou = (held(v, 0.01, 0.99) for v in (self.iou, self.low_iou, self.duplicate_iou))
        self.buffer = max(self.buffer, 1)

    def update(self, frame_id: int, boxes: np.ndarray, scores: np.ndarray, width: int = 0, height: int = 0) -> list[tuple[int, list[float], float, bool]]:
        self.frame = frame_id if frame_id > 0 else self.frame + 1
        if self.grid:
            self.grid.begin_frame()
        fit = [(box, score) for box, score in zip(boxes.tolist(), scores.tolist(), strict=True) if box[2] > 1 and box[3] > 1 and box[2] * box[3] >= self.least_area]
        sure, unsure = [d for d in fit if d[1] >= self.high], [d for d in fit if self.low <= d[1] < self.high]
        for t in self.tracks:
            t.predict()
        cell = partial(self.grid.cell, width=width, height=height) if self.grid and width > 0 and height > 0 else None
        rest, left = self._round([*(t for t in self.tracks if not t.lost), *(t for t in self.tracks if t.lost)], sure, self.iou, cell)
        missed, _ = self._round([t for t in rest if not t.lost], unsure, self.low_iou, cell)
        for t in missed:
            t.lost = True
        for box, score in left:
            if score >= self.new:
                self.tracks.append(Moving.begin(self.next_id, box, score, self.frame))
                self.next_id += 1
                if cell:
                    self.grid.observe(cell(box))
        self.tracks = self._distinct([t for t in self.tracks if not t.lost or self.frame - t.seen <= self.buffer])
        return [(t.id, t.box, t.score, False) for t in self.tracks if not t.lost]

    def _round(self, some: list[Moving], dets: list[tuple[list[float], float]], least: float, cell) -> tuple[list[Moving], list[tuple[list[float], float]]]:
        """Matches some of the tracks with detections; gives what is left of both.

        A cost is 1 without overlap and at most grid.most more. A track and a detection that overlap each other only, and whose overlap saves more than
        twice that, are together in any cheapest assignment: wherever they stood apart, bringing them together would cost less. Only the others are
        assigned by costs, and only if some of them overlap enough to match.
        """
        iou = {(i, j): v for i, j, v in touching([t.box for t in some], [box for box, _ in dets])}
        weight = [min(max(score, 0.0), 1.0) if self.fuse_score else 1.0 for _, score in dets]
        by_track, by_det = Counter(i for i, _ in iou), Counter(j for _, j in iou)
        most = 2 * abs(self.grid.most) if cell else 0.0
        pairs = [(i, j) for (i, j), v in iou.items() if by_track[i] == by_det[j] == 1 and v * weight[j] > most]
        rows, cols = {i for i, _ in pairs}, {j for _, j in pairs}
        open_pairs = {(i, j): v for (i, j), v in iou.items() if i not in rows and j not in cols}
        if any(v >= least for v in open_pairs.values()):
            free, found = [i for i in range(len(some)) if i not in rows], [j for j in range(len(dets)) if j not in cols]
            row, col, still = {i: k for k, i in enumerate(free)}, {j: k for k, j in enumerate(found)}, np.zeros((len(free), len(found)))
            for (i, j), v in open_pairs.items():
                still[row[i], col[j]] = v
            pairs += [(free[i], found[j]) for i, j in self._assigned([some[i].box for i in free], [dets[j][0] for j in found], still * [weight[j] for j in found], cell)]
        pairs = [(i, j) for i, j in pairs if iou.get((i, j), 0.0) >= least]
        if cell:
            for i, j in pairs:
                self.grid.observe(cell(dets[j][0]), cell(some[i].box))
        for i, j in pairs:
            some[i].update(*dets[j], self.frame)
        rows, cols = {i for i, _ in pairs}, {j for _, j in pairs}
        return [t for i, t in enumerate(some) if i not in rows], [d for j, d in enumerate(dets) if j not in cols]

    def _assigned(self, tracks: list[list[float]], dets: list[list[float]], saved: np.ndarray, cell) -> list[tuple[int, int]]:
        """The pairs of the cheapest assignment of boxes, given what the overlap of each pair saves."""
        if saved.size == 1:
            return [(0, 0)]
        return assign(1 - saved + (self.grid.cost(np.array([cell(box) for box in tracks]), np.array([cell(box) for box in dets])) if cell else 0.0))

    def _distinct(self, tracks: list[Moving]) -> list[Moving]:
        """Of a seen and a lost track on one place, the one that lived longer stays; a tie keeps the lost one."""
        seen, lost = [t for t in tracks if not t.lost], [t for t in tracks if t.lost]
        gone = set()
        for i, j, v in touching([t.box for t in seen], [t.box for t in lost]):
            if v >= self.duplicate_iou:
                a, b = seen[i], lost[j]
                gone.add(b.id if a.seen - a.start > b.seen - b.start else a.id)
        return [t for t in tracks if t.id not in gone] if gone else tracks


@dataclass
class DemoTracker:
    """Boxes that drift with a damped speed and take the detection that overlaps them most, sure ones first. The defaults, and the weights of speed, are fixed values."""

    high: float = 0.6
    low: float = 0.2
    iou: float = 0.3
    low_iou: float = 0.2
    least_hits: int = 2
    most_missed: int = 20
    tracks: list[dict] = field(default_factory=list)
    next_id: int = 1

    def update(self, frame_id: int, boxes: np.ndarray, scores: np.ndarray, width: int = 0, height: int = 0) -> list[tuple[int, np.ndarray, float, bool]]:
        for t in self.tracks:
            t["missed"] += 1
            t["speed"] = t["speed"] * (0.55 if t["missed"] > 3 else 0.8)
            t["box"] = t["box"] + t["speed"]
            t["box"][2:] = np.maximum(t["box"][2:], 1.0)
        free = self._take(self.tracks, np.flatnonzero(scores >= self.high), boxes, scores, self.iou)
        self._take(free[0], np.flatnonzero((scores >= self.low) & (scores < self.high)), boxes, scores, self.low_iou)
        for d in free[1]:
            self.tracks.append({"id": self.next_id, "box": boxes[d].astype(float), "speed": np.zeros(4), "hits": 1, "missed": 0, "score": float(scores[d])})
            self.next_id += 1
        self.tracks = [t for t in self.tracks if t["missed"] <= self.most_missed]
        return [(t["id"], t["box"], t["score"], t["missed"] > 0) for t in self.tracks if t["hits"] >= self.least_hits or t["missed"] == 0]

    @staticmethod
    def _take(tracks: list[dict], dets: np.ndarray, boxes: np.ndarray, scores: np.ndarray, least: float) -> tuple[list[dict], list[int]]:
        rows, cols = set(), set()
        if tracks and len(dets):
            iou = overlap(np.array([t["box"] for t in tracks]), boxes[dets])
            for flat in np.argsort(-iou, axis=None, kind="stable"):
                i, j = divmod(int(flat), len(dets))
                if iou[i, j] < least:
                    break
                if i not in rows and j not in cols:
                    rows.add(i)
                    cols.add(j)
                    t, d = tracks[i], dets[j]
                    t["speed"] = 0.35 * (boxes[d] - t["box"]) + 0.65 * t["speed"]
                    t.update(box=boxes[d].astype(float), hits=t["hits"] + 1, missed=0, score=float(scores[d]))
        return [t for i, t in enumerate(tracks) if i not in rows], [int(d) for j, d in enumerate(dets) if j not in cols]


TRACKERS = {"bytetrack": ByteTracker, "demo": DemoTracker}
TRACKED = "stream_id string, frame_id bigint, track_id bigint, x double, y double, w double, h double, score double, occluded boolean"


#: What a tracker reads of a detection.
SEEN = ["x", "y", "w", "h", "score", "width", "height"]


def tracked_rows(tracker, stream: str, frame: int, values: np.ndarray) -> list[tuple]:
    """What a tracker shows of a frame; values has a row of SEEN for each detection."""
    # a size that is null in all of a frame's rows is 0
    width, height = (int(v) if v == v else 0 for v in np.fmax.reduce(values[:, 5:], axis=0).tolist())
    out = tracker.update(int(frame), values[:, :4], values[:, 4], width, height)
    frame = int(frame)
    return [(stream, frame, int(i), *map(float, box), score, hidden) for i, box, score, hidden in out]


def track(detections: DataFrame, kind: str = "bytetrack", **how) -> DataFrame:
    """Follows boxes (stream_id, frame_id, det_idx, x, y, w, h, score) through the frames (width, height) of each stream.

    A frame without any row is not seen; ids count from 1 in each stream.
    """

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tracker, rows = None, None, []
        for (stream, frame), values in runs(batches, ["stream_id", "frame_id"], SEEN):
            if stream != now:
                now, tracker = stream, TRACKERS[kind](**how)
            rows += tracked_rows(tracker, stream, frame, values)
            if len(rows) > 10_000:
                yield _batch(rows, TRACKED)
                rows = []
        yield _batch(rows, TRACKED)

    return in_order(detections, ["stream_id"], "frame_id", "det_idx").mapInArrow(follow, TRACKED)


def simplified(points: np.ndarray, eps: float) -> np.ndarray:
    """Drops the points of a line that lie within eps of a chord between points that stay."""
    if len(points) <= 2 or eps <= 0:
        return points
    stay = np.zeros(len(points), bool)
    stay[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        way, off = points[b] - points[a], points[a + 1 : b] - points[a]
        size = np.hypot(*way)
        far = np.abs(way[0] * off[:, 1] - way[1] * off[:, 0]) / size if size > 0 else np.hypot(off[:, 0], off[:, 1])
        k = int(np.argmax(far))
        if far[k] > eps:
            stay[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[stay]


ROUTES = "stream_id string, profile string, route_id string, support bigint, last_seen_ms bigint, n_points int, points array<struct<x: double, y: double>>"
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


class Routes:
    """The routes of one stream, in the order in which they began, by the squares of the side `near` in which they begin and end.

    Routes of two equal squares differ by more than near, so that such a pair of squares holds few of them, however many a stream has.
    """

    def __init__(self, near: float):
        self.near = near
        self.ends: list[tuple[float, float, float, float]] = []
        self.points: list[np.ndarray] = []
        self.support: list[int] = []
        self.seen: list[int] = []
        self.squares: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = {}

    def around(self, x: float, y: float) -> list[tuple[float, tuple[int, int]]]:
        """The squares that hold points within near of this one, nearest first, with their distance from it."""
        col, row = int(x // self.near), int(y // self.near)
        left, top = x - col * self.near, y - row * self.near
        across, down = ((col, 0.0), (col - 1, left), (col + 1, self.near - left)), ((row, 0.0), (row - 1, top), (row + 1, self.near - top))
        return sorted((hypot(dx, dy), (c, r)) for c, dx in across for r, dy in down if hypot(dx, dy) <= self.near + 1e-6)

    def first_near(self, x1: float, y1: float, x2: float, y2: float) -> int | None:
        """The first route whose ends lie within near of these, both distances together, either way round."""
        best = None
        first, last = self.around(x1, y1), self.around(x2, y2)
        for turned, (begin, end) in enumerate(((first, last), (last, first))):
            for far, square in begin:
                ends = self.squares.get(square, {})
                for further, other in end:
                    # a hair of room for rounding
                    if far + further > self.near + 1e-6:
                        break
                    for k in ends.get(other, ()):
                        if best is not None and k >= best:
                            break
                        a, b, c, d = self.ends[k]
                        if (hypot(c - x1, d - y1) + hypot(a - x2, b - y2) if turned else hypot(a - x1, b - y1) + hypot(c - x2, d - y2)) <= self.near:
                            best = k
                            break
        return best

    def add(self, points: np.ndarray, ts: int) -> None:
        ends = (*points[0].tolist(), *points[-1].tolist())
        k = self.first_near(*ends)
        if k is not None:
            self.support[k] += 1
            self.seen[k] = ts
            return
        begin, end = ((int(x // self.near), int(y // self.near)) for x, y in zip(ends[::2], ends[1::2], strict=True))
        self.squares.setdefault(begin, {}).setdefault(end, []).append(len(self.ends))
        self.ends.append(ends)
        self.points.append(points)
        self.support.append(1)
        self.seen.append(ts)

    def shown(self, stream: str, profile: str) -> pa.RecordBatch:
        n = len(self.ends)
        flat = np.concatenate(self.points) if n else np.zeros((0, 2))
        upto = np.append(0, np.cumsum([len(p) for p in self.points])).astype(np.int32)
        points = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["x", "y"]))
        columns = [pa.array([stream] * n, pa.string()), pa.array([profile] * n, pa.string()), pa.array([f"route-{k}" for k in range(1, n + 1)], pa.string()), pa.array(self.support, pa.int64()), pa.array(self.seen, pa.int64()), pa.array(np.diff(upto), pa.int32()), points.cast(_POINTS)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROUTES.split(", ")[:6]] + ["points"])


def _lines(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The points of each row's way, as a matrix of two columns."""
    points = batch.column("points")
    flat, bounds = points.flatten(), points.offsets.to_numpy()
    xy = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xy"])
    for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True):
        yield xy[a:b]


def routes(ways: DataFrame, eps: float = 3.0) -> DataFrame:
    """Routes of each stream: a finished way joins the first route whose ends lie near its own, either way round, else begins one."""
    near = max(20.0, 10 * eps)
    done = ways.filter(F.col("lost_frame_id").isNotNull() & (F.size("points") >= 2))
    flat = done.select("stream_id", "profile", "lost_frame_id", "track_id", "lost_ts_ms", F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("points"))

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [simplified(p, eps) for p in _lines(batch)]
            xy = np.concatenate(lines) if lines else np.zeros((0, 2))
            upto = pa.array(np.append(0, np.cumsum([len(p) for p in lines])), pa.int32())
            points = pa.ListArray.from_arrays(upto, pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], names=["x", "y"]))
            yield batch.set_column(batch.schema.get_field_index("points"), "points", points.cast(_POINTS))

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            of = zip(batch.column("stream_id").to_pylist(), batch.column("profile").to_pylist(), strict=True)
            for key, line, ts in zip(of, _lines(batch), batch.column("lost_ts_ms").to_pylist(), strict=True):
                if key != now:
                    if known is not None:
                        yield known.shown(*now)
                    now, known = key, Routes(near)
                known.add(line, ts)
        if known is not None:
            yield known.shown(*now)

    thinned = flat.mapInArrow(thin, flat.schema)
    return in_order(thinned, ["stream_id", "profile"], "lost_frame_id", "track_id").mapInArrow(learn, ROUTES)

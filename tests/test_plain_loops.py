"""The queries that have no SQL against plain loops over the whole table, and folds that the fixtures don't reach."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict
from math import hypot, isclose
from types import SimpleNamespace

import numpy as np
import pytest

from wayline.operators import analytics as A
from wayline.operators import detect, telemetry
from wayline.operators import tracking as K
from wayline.operators.sequence import gated
from wayline.plans.queries import QUERIES
from wayline.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (max(a[2], 0) * max(a[3], 0) + max(b[2], 0) * max(b[3], 0) - w * h)


def cheapest(cost):
    """The cheapest matching of as many pairs as there can be, over all sets of columns."""
    rows, cols = len(cost), len(cost[0]) if cost else 0
    best = {0: (0.0, ())}
    for i in range(rows):
        for mask, (c, pairs) in list(best.items()):
            for j in range(cols):
                if not mask >> j & 1 and (mask | 1 << j not in best or c + cost[i][j] < best[mask | 1 << j][0] - 1e-12):
                    if all(p[0] != i for p in pairs):
                        best[mask | 1 << j] = (c + cost[i][j], (*pairs, (i, j)))
    full = [v for m, v in best.items() if bin(m).count("1") == min(rows, cols)]
    return list(min(full)[1]) if full else []


def by_frame(rows):
    out = defaultdict(lambda: defaultdict(list))
    for r in sorted(rows, key=lambda r: (r.stream_id, r.frame_id, r.det_idx)):
        out[r.stream_id][r.frame_id].append(r)
    return out


class Axis:
    """A place and a speed with their uncertainty: what each of a box's four measures is on its own."""

    def __init__(self, at, place, speed):
        self.at, self.speed, self.pp, self.pv, self.vv = at, 0.0, place**2, 0.0, speed**2

    def predict(self, place, speed):
        self.at += self.speed
        self.pp, self.pv, self.vv = self.pp + 2 * self.pv + self.vv + place**2, self.pv + self.vv, self.vv + speed**2

    def update(self, seen, noise):
        s = self.pp + noise**2
        k, m, off = self.pp / s, self.pv / s, seen - self.at
        self.at, self.speed = self.at + k * off, self.speed + m * off
        self.pp, self.pv, self.vv = (1 - k) * self.pp, (1 - k) * self.pv, self.vv - m * self.pv


class PlainTrack:
    def __init__(self, id_, box, score, frame):
        self.id, self.score, self.start, self.seen, self.lost = id_, score, frame, frame, False
        h = max(box[3], 1)
        self.axes = [Axis(v, 2 * p, 10 * s) for v, p, s in zip(self.centre(box), (h / 20, h / 20, 1e-2 / 2, h / 20), (h / 160, h / 160, 1e-5 / 10, h / 160))]
        self.box = tuple(box)

    @staticmethod
    def centre(box):
        w, h = max(box[2], 1), max(box[3], 1)
        return box[0] + w / 2, box[1] + h / 2, w / h, h

    def shown(self):
        cx, cy, aspect, h = (a.at for a in self.axes)
        h = max(h, 1)
        w = max(aspect * h, 1)
        return cx - w / 2, cy - h / 2, w, h

    def predict(self):
        h = max(self.axes[3].at, 1)
        for a, p, s in zip(self.axes, (h / 20, h / 20, 1e-2, h / 20), (h / 160, h / 160, 1e-5, h / 160)):
            if self.lost:
                a.speed = 0.0
            a.predict(p, s)
        self.box = self.shown()

    def update(self, box, score, frame):
        h = max(self.axes[3].at, 1)
        for a, v, n in zip(self.axes, self.centre(box), (h / 20, h / 20, 1e-1, h / 20)):
            a.update(v, n)
        self.score, self.seen, self.lost, self.box = score, frame, False, self.shown()


def plain_bytetrack(frames):
    tracks, next_id, last, used, moved, begun = [], 1, 0, [0.0] * 48, [[0.0] * 48 for _ in range(48)], 0
    cell = lambda b: min(int(min(max(b[1] + 0.95 * b[3], 0), 719) / 720 * 6), 5) * 8 + min(int(min(max(b[0] + b[2] / 2, 0), 1279) / 1280 * 8), 7)
    for frame_id, dets in frames.items():
        last = frame_id if frame_id > 0 else last + 1
        begun += 1
        used, moved = [v * 0.92 for v in used], [[v * 0.98 for v in row] for row in moved]
        boxes = [((r.x, r.y, r.w, r.h), r.score) for r in dets]
        for t in tracks:
            t.predict()

        def match(some, free, least):
            cost = []
            for t in some:
                row = []
                for box, score in free:
                    a, b = cell(t.box), cell(box)
                    far = hypot(a // 8 - b // 8, a % 8 - b % 8) / hypot(5, 7)
                    share = used[b] / max(used) if max(used) > 0 else 0
                    chance = moved[a][b] / sum(moved[a]) if sum(moved[a]) > 0 else 0
                    extra = 0.15 * (0.65 * min(far, 1) + 0.15 * (1 - share) + 0.2 * (1 - chance)) if begun >= 5 else 0
                    row.append(1 - iou(t.box, box) * score + min(extra, 0.3))
                cost.append(row)
            pairs = [(i, j) for i, j in (cheapest(cost) if cost and free else []) if iou(some[i].box, free[j][0]) >= least]
            ways = [(cell(some[i].box), cell(free[j][0])) for i, j in pairs]
            for a, b in ways:
                moved[a][b] += 1
                used[b] += 1
            for i, j in pairs:
                some[i].update(*free[j], last)
            return [t for i, t in enumerate(some) if all(i != p for p, _ in pairs)], [d for j, d in enumerate(free) if all(j != q for _, q in pairs)]

        rest, left = match([t for t in tracks if not t.lost] + [t for t in tracks if t.lost], [b for b in boxes if b[1] >= 0.45], 0.35)
        missed, _ = match([t for t in rest if not t.lost], [b for b in boxes if 0.2 <= b[1] < 0.45], 0.25)
        for t in missed:
            t.lost = True
        for box, score in left:
            tracks.append(PlainTrack(next_id, box, score, last))
            next_id += 1
            used[cell(box)] += 1
        tracks = [t for t in tracks if not t.lost or last - t.seen <= 100]
        gone = set()
        for a in tracks:
            for b in tracks:
                if not a.lost and b.lost and iou(a.box, b.box) >= 0.85:
                    gone.add(b.id if a.seen - a.start > b.seen - b.start else a.id)
        tracks = [t for t in tracks if t.id not in gone]
        for t in tracks:
            if not t.lost:
                yield frame_id, t.id, t.box, t.score, False


def plain_demo(frames):
    tracks, next_id = [], 1
    for frame_id, dets in frames.items():
        for t in tracks:
            t["missed"] += 1
            t["speed"] = [v * (0.55 if t["missed"] > 3 else 0.8) for v in t["speed"]]
            t["box"] = [b + v for b, v in zip(t["box"], t["speed"])]
            t["box"][2:] = [max(v, 1) for v in t["box"][2:]]
        free = tracks
        unused = []
        for low, high, least in ((0.6, 9, 0.3), (0.2, 0.6, 0.2)):
            some = [r for r in dets if low <= r.score < high]
            order = sorted((-iou(t["box"], (r.x, r.y, r.w, r.h)), i, j) for i, t in enumerate(free) for j, r in enumerate(some))
            rows, cols = set(), set()
            for v, i, j in order:
                if -v >= least and i not in rows and j not in cols:
                    rows.add(i)
                    cols.add(j)
                    r, t = some[j], free[i]
                    box = [r.x, r.y, r.w, r.h]
                    t.update(speed=[0.35 * (n - b) + 0.65 * s for n, b, s in zip(box, t["box"], t["speed"])], box=box, missed=0, hits=t["hits"] + 1, score=r.score)
            free = [t for i, t in enumerate(free) if i not in rows]
            if low == 0.6:
                unused = [r for j, r in enumerate(some) if j not in cols]
        for r in unused:
            tracks.append({"id": next_id, "box": [r.x, r.y, r.w, r.h], "speed": [0.0] * 4, "hits": 1, "missed": 0, "score": r.score})
            next_id += 1
        tracks = [t for t in tracks if t["missed"] <= 20]
        for t in tracks:
            if t["hits"] >= 2 or t["missed"] == 0:
                yield frame_id, t["id"], tuple(t["box"]), t["score"], t["missed"] > 0


@pytest.mark.parametrize("kind, plain", [("bytetrack", plain_bytetrack), ("demo", plain_demo)])
def test_trackers_by_plain_loops(spark, kind, plain):
    got = defaultdict(list)
    for r in K.track(X.detections(spark, SF), kind).collect():
        got[r.stream_id].append((r.frame_id, r.track_id, (r.x, r.y, r.w, r.h), r.score, r.occluded))
    for stream, frames in by_frame(X.detections(spark, SF).collect()).items():
        want, mine = sorted(plain(frames)), sorted(got[stream])
        assert [(w[0], w[1], w[3], w[4]) for w in want] == [(m[0], m[1], m[3], m[4]) for m in mine]
        assert all(isclose(a, b, abs_tol=1e-6) for w, m in zip(want, mine) for a, b in zip(w[2], m[2]))


@pytest.mark.parametrize("seed", range(6))
def test_crowded_tracker_by_plain_loops(seed):
    """Boxes that overlap several others, sure and unsure: matches are those of costs over all pairs."""
    rng, frames = random.Random(seed), {}
    at = [[rng.uniform(0, 150), rng.uniform(0, 100)] for _ in range(4)]
    for frame in range(1, 40):
        at = [[x + rng.uniform(-12, 12), y + rng.uniform(-8, 8)] for x, y in at]
        frames[frame] = [SimpleNamespace(x=x, y=y, w=90.0, h=120.0, score=rng.choice([0.3, 0.5, 0.9])) for x, y in at if rng.random() > 0.1]
    frames = {k: v for k, v in frames.items() if v}
    tracker, got = K.ByteTracker(), []
    for frame, dets in frames.items():
        values = np.array([(d.x, d.y, d.w, d.h, d.score, 1280, 720) for d in dets])
        got += [(r[1], r[2], r[3:7], r[7], r[8]) for r in K.tracked_rows(tracker, "cam", frame, values)]
    want, got = sorted(plain_bytetrack(frames)), sorted(got)
    assert [(w[0], w[1], w[3], w[4]) for w in want] == [(g[0], g[1], g[3], g[4]) for g in got] and tracker.next_id > 4
    assert all(isclose(a, b, abs_tol=1e-6) for w, g in zip(want, got) for a, b in zip(w[2], g[2]))


def test_assignment_by_plain_loops(spark):
    pairs = defaultdict(list)
    for r in detect.iou_pairs(*(d for d in (X.crowded(spark, SF).withColumn("frame_id", X.F.col("frame_id") + 1), X.crowded(spark, SF)))).collect():
        pairs[r.stream_id, r.frame_id].append(r)
    got = {(r.stream_id, r.frame_id, r.track_idx, r.det_idx) for r in QUERIES["assoc_optimal"](spark, SF).collect()}
    assert len(pairs) > 100
    for (stream, frame), rows in pairs.items():
        tracks, dets = sorted({r.track_idx for r in rows}), sorted({r.det_idx for r in rows})
        of = {(r.track_idx, r.det_idx): r for r in rows}
        best = cheapest([[of[t, d].cost if (t, d) in of else 1.0 for d in dets] for t in tracks])
        mine = [(t, d) for s, f, t, d in got if (s, f) == (stream, frame)]
        cost = lambda some: sum(of[p].cost - 1 for p in some)
        want = [(tracks[i], dets[j]) for i, j in best if (tracks[i], dets[j]) in of and of[tracks[i], dets[j]].iou >= 0.3]
        assert cost(mine) == pytest.approx(cost(want)) and len({t for t, _ in mine}) == len({d for _, d in mine}) == len(mine)


def test_routes_by_plain_loops(spark):
    where = "/root/testdata/sf0.01"
    ways = A.route_points(X.track_obs(spark, where)).filter("lost_frame_id is not null and size(points) >= 2").collect()
    want = defaultdict(list)
    for w in sorted(ways, key=lambda w: (w.lost_frame_id, w.track_id)):
        p = [(q.x, q.y) for q in w.points]
        for r in want[w.stream_id]:
            q = r["points"]
            there, back = hypot(q[0][0] - p[0][0], q[0][1] - p[0][1]) + hypot(q[-1][0] - p[-1][0], q[-1][1] - p[-1][1]), hypot(q[-1][0] - p[0][0], q[-1][1] - p[0][1]) + hypot(q[0][0] - p[-1][0], q[0][1] - p[-1][1])
            if min(there, back) <= 30:
                r["support"] += 1
                r["seen"] = w.lost_ts_ms
                break
        else:
            want[w.stream_id].append({"points": p, "support": 1, "seen": w.lost_ts_ms})
    got = {(r.stream_id, r.route_id): (r.support, r.last_seen_ms, tuple(r.points[0]), tuple(r.points[-1])) for r in QUERIES["routes_clustered"](spark, where).collect()}
    assert got == {(s, f"route-{k}"): (r["support"], r["seen"], r["points"][0], r["points"][-1]) for s, routes in want.items() for k, r in enumerate(routes, 1)}
    assert any(r[0] > 1 for r in got.values())


def plain_order(frames, window, most):
    """(frame, arrival) as in a store of waiting frames that is looked through frame id by frame id."""
    turn, newest, waiting, out = frames[0][0], frames[0][0], {}, []
    for frame, arrival in frames:
        newest = max(newest, frame)
        waiting[frame] = arrival
        waiting = {f: a for f, a in waiting.items() if f >= turn}
        while True:
            if turn in waiting:
                del waiting[turn]
                out.append((turn, arrival))
            elif newest - turn <= window:
                break
            turn += 1
        while len(waiting) > most:
            del waiting[min(waiting)]
    return out


@pytest.mark.parametrize("most", [500, 2])
def test_frame_order_by_plain_loops(spark, most):
    import random

    rng = random.Random(4)
    frames = [f for f in range(300) if rng.random() > 0.1]
    arrivals = sorted((f + rng.choice([0, 0, 0, 3, 9]) + rng.random() / 2, f) for f in [*frames, *frames[::17]])
    rows = [("cam0", f, k) for k, (_, f) in enumerate(arrivals)] + [("cam1", 7, 1), ("cam1", 8, 2)]
    got = telemetry.in_frame_order(spark.createDataFrame(rows, "stream_id string, frame_id bigint, arrival bigint"), 5, most).collect()
    assert [(r.frame_id, r.arrival) for r in sorted(got, key=lambda r: (r.arrival, r.frame_id)) if r.stream_id == "cam0"] == plain_order([(f, k) for _, f, k in rows if _ == "cam0"], 5, most)
    assert sorted((r.frame_id, r.arrival) for r in got if r.stream_id == "cam1") == [(7, 1), (8, 2)]


def test_suppression_of_a_chain(spark):
    """The middle of a chain goes, so it suppresses nothing itself."""
    rows = [("cam0", 1, k, 30.0 * k, 0.0, 100.0, 100.0, 0.9 - k / 10) for k in range(5)]
    got = detect.suppressed(spark.createDataFrame(rows, "stream_id string, frame_id bigint, det_idx int, x double, y double, w double, h double, score double")).collect()
    kept = []
    for r in sorted(rows, key=lambda r: -r[7]):
        if all(iou(r[3:7], q[3:7]) <= 0.45 for q in kept):
            kept.append(r)
    assert sorted(r.det_idx for r in got) == sorted(r[2] for r in kept) == [0, 2, 4]


def test_frames_of_one_moment_pair_once(spark):
    schema = "stream_id string, frame_id bigint, pts_ns bigint"
    a = spark.createDataFrame([("c", 1, 5), ("c", 2, 5), ("c", 3, 9), ("c", 4, 0), ("c", 6, 0)], schema)
    b = spark.createDataFrame([("c", 11, 5), ("c", 12, 5), ("c", 13, 5), ("c", 14, 0)], schema)
    assert sorted((r.frame_id, r.ui_frame_id) for r in telemetry.paired(a, b).collect()) == [(1, 11), (2, 12), (4, 14)]


def test_gate_reads_a_long_key_in_order(spark):
    times = [k * 37 % 9001 for k in range(9000)]
    rows = [("a", t, 100) for t in times] + [("b", t, 1) for t in times[:50]] + [("c", 5, 10)]
    got = defaultdict(list)
    for r in gated(spark.createDataFrame(rows, "k string, t bigint, g int"), ["k"], "t", X.F.col("g")).collect():
        got[r.k].append(r.t)
    for k, gap in (("a", 100), ("b", 1), ("c", 10)):
        want = []
        for t in sorted(t for key, t, _ in rows if key == k):
            if not want or t - want[-1] >= gap:
                want.append(t)
        assert sorted(got[k]) == want


def test_matching_of_sets_is_the_cheapest():
    import random

    rng = random.Random(1)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        cost = [[rng.random() for _ in range(m)] for _ in range(n)]
        few, many = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = min(sum(cost[i][j] if n <= m else cost[j][i] for i, j in zip(few, p)) for p in itertools.permutations(many, len(few)))
        assert sum(cost[i][j] for i, j in cheapest(cost)) == pytest.approx(best)

"""Trackers, assignment, routes and events against hand-made cases and plain loops."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from wayline.functions import geometry as G
from wayline.operators import analytics as A
from wayline.operators import scene_grid
from wayline.operators import tracking as K
from wayline.sources import fixtures as X
from wayline.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (4, 2), (5, 5), (3, 6)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = rng.random(shape).round(2)
        n, m = shape
        few, many = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(few[i, p[i]] for i in range(len(few))) for p in itertools.permutations(range(many), len(few)))
        got = K.assign(cost)
        assert len(got) == min(shape) and sum(cost[i, j] for i, j in got) == pytest.approx(best)


def boxes(*rows):
    return np.array(rows, float)


def test_crossed_detections_match_by_place():
    tracks, dets = boxes((0, 0, 50, 50), (200, 0, 50, 50)), boxes((202, 0, 50, 50), (2, 0, 50, 50))
    iou = K.overlap(tracks, dets)
    assert K.matched(1 - iou, iou, 0.3)[0] == [(0, 1), (1, 0)]


def test_overlap_gates_and_cost_does_not():
    iou = K.overlap(boxes((0, 0, 10, 10)), boxes((100, 100, 10, 10)))
    assert K.matched(1 - iou, iou, 0.5) == ([], [0], [0])


def test_track_keeps_its_id_over_a_miss_and_a_weak_detection():
    t = K.ByteTracker()
    box = boxes((100, 100, 80, 180))
    first = t.update(1, box, np.array([0.9]))
    assert t.update(2, np.zeros((0, 4)), np.zeros(0)) == []
    again = t.update(3, box, np.array([0.9]))
    weak = t.update(4, box, np.array([0.25]))
    assert first[0][0] == again[0][0] == weak[0][0] == 1


AMBIGUOUS = boxes((8, 140, 100, 100), (0, 145, 100, 100))


def test_grid_takes_an_ambiguous_match_to_the_same_cell():
    near = K.SceneGrid(rows=2, cols=2, warmup=0, weight=0.3, far=1.0, rare=0.0, odd=0.0)
    for grid, width, right in ((near, 640, True), (near, 0, False), (None, 640, False)):
        t = K.ByteTracker(grid=grid)
        t.update(1, boxes((0, 140, 100, 100)), np.array([0.9]), width, 480)
        (first, *_) = t.update(2, AMBIGUOUS, np.array([0.9, 0.9]), width, 480)
        assert first[0] == 1 and (first[1][0] > 0) == right and (first[1][1] > 140) != right
    assert near.frames == 0 and not near.used.any()


def test_grid_adds_nothing_past_the_overlap_gate():
    t = K.ByteTracker(grid=K.SceneGrid(warmup=0, weight=0.3, rare=1.0, odd=1.0))
    t.update(1, boxes((0, 0, 100, 100)), np.array([0.9]), 640, 480)
    assert [x[0] for x in t.update(2, boxes((5, 0, 100, 100)), np.array([0.9]), 640, 480)] == [1]
    assert [x[0] for x in t.update(3, boxes((300, 0, 100, 100)), np.array([0.9]), 640, 480)] == [2]


@pytest.mark.parametrize("weak", [False, True])
def test_grid_counts_and_cost_by_plain_loops(weak):
    rng = np.random.default_rng(5)
    t, used, moved = K.ByteTracker(iou=0.01, low_iou=0.01), [0.0] * 48, [[0.0] * 48 for _ in range(48)]
    cell = lambda b: min(int(min(max(b[1] + 0.95 * b[3], 0), 479) / 480 * 6), 5) * 8 + min(int(min(max(b[0] + b[2] / 2, 0), 639) / 640 * 8), 7)
    box = np.array([300.0, 200.0, 120.0, 160.0])
    for frame in range(1, 30):
        expected = None
        if frame > 1:
            ahead = K.Moving(0, t.tracks[0].box.copy(), 0, 0, 0, t.tracks[0].lost, t.tracks[0].mean.copy(), t.tracks[0].spread.copy())
            ahead.predict()
            expected = ahead.box
        box = box + np.append(rng.uniform(-25, 25, 2), [0, 0])
        used, moved = [0.92 * x for x in used], [[0.98 * x for x in row] for row in moved]
        (shown,) = t.update(frame, box[None], np.array([0.3 if weak and frame > 1 else 0.9]), 640, 480)
        assert shown[0] == 1
        used[cell(box)] += 1
        if expected is not None:
            moved[cell(expected)][cell(box)] += 1
        assert np.allclose(t.grid.used, used) and np.allclose(t.grid.moved, moved)
        a, b = rng.uniform(0, 400, (3, 4)), rng.uniform(0, 400, (4, 4))
        got = np.broadcast_to(t.grid.extra_cost(a, b, 640, 480), (3, 4))
        for i, j in itertools.product(range(3), range(4)):
            p, q = cell(a[i]), cell(b[j])
            far = ((p // 8 - q // 8) ** 2 + (p % 8 - q % 8) ** 2) ** 0.5 / 74**0.5
            chance = moved[p][q] / sum(moved[p]) if sum(moved[p]) else 0
            want = 0.15 * (0.65 * far + 0.15 * (1 - used[q] / max(used)) + 0.2 * (1 - chance)) if frame >= 5 else 0
            assert got[i, j] == pytest.approx(want)


def test_grid_tables_by_frame_after_frame(spark):
    rng = np.random.default_rng(8)
    rows = [("cam0", f, t, 640, 480, float(x), float(y), 50.0, 60.0, 0.9) for t in range(4) for f in range(1 + 3 * t, 60) for x, y in [rng.uniform(0, 200, 2) + (300 if f > 30 else 0)]]
    used, moved, last = np.zeros(48), np.zeros((48, 48)), {}
    for frame in range(1, 60):
        used, moved = used * 0.92, moved * 0.98
        for _, f, t, _, _, x, y, w, h, _ in rows:
            if f == frame:
                cell = min(int(min(y + 0.95 * h, 479) / 480 * 6), 5) * 8 + min(int(min(x + w / 2, 639) / 640 * 8), 7)
                used[cell] += 1
                if t in last:
                    moved[last[t], cell] += 1
                last[t] = cell
    det = spark.createDataFrame(rows, "stream_id string, frame_id bigint, det_idx int, width int, height int, x double, y double, w double, h double, score double")
    occupied, ways = scene_grid.occupancy(det), scene_grid.transitions(det)
    got = {r.cell: (r.used, r.share) for r in occupied.collect()}
    assert got == {c: pytest.approx((used[c], used[c] / used.max())) for c in np.flatnonzero(used)}
    got = {(r.from_cell, r.cell): (r.recent, r.probability) for r in ways.collect()}
    assert got == {(a, b): pytest.approx((moved[a, b], moved[a, b] / moved[a].sum())) for a, b in zip(*np.nonzero(moved), strict=True)}
    grid = K.SceneGrid(warmup=0)
    grid.used, grid.moved = used, moved
    middle = lambda c: boxes(((c % 8 + 0.5) * 80 - 1, (c // 8 + 0.5) * 80 - 1.9, 2, 2))
    for r in scene_grid.extra_cost(ways.join(occupied, ["stream_id", "cell"])).collect():
        assert r.grid_cost == pytest.approx(grid.extra_cost(middle(r.from_cell), middle(r.cell), 640, 480)[0, 0])


@pytest.mark.parametrize("frames, same_cell", [(3, False), (10, True)])
def test_tracked_table_uses_the_grid_after_its_warm_up(spark, frames, same_cell):
    rows = [("cam0", f, 0, 640, 480, 0.0, 140.0, 100.0, 100.0, 0.9) for f in range(1, frames + 1)]
    rows += [("cam0", frames + 1, d, 640, 480, *map(float, b), 0.9) for d, b in enumerate(AMBIGUOUS)]
    det = spark.createDataFrame(rows, "stream_id string, frame_id bigint, det_idx int, width int, height int, x double, y double, w double, h double, score double")
    (first,) = K.track(det).filter(f"frame_id = {frames + 1} AND track_id = 1").collect()
    assert (first.x > 0.01) == same_cell and (first.y > 140.01) != same_cell


def test_lanes_need_hardly_any_assignment(monkeypatch):
    """Boxes that overlap their own track only are matched without costs, also after frames in which they were missing."""
    calls, plain = [], K.assign
    monkeypatch.setattr(K, "assign", lambda cost: calls.append(cost.shape) or plain(cost))
    t = K.ByteTracker()
    for frame in range(1, 301):
        seen = [k for k in range(6) if (frame + 5 * k) % 11]
        shown = t.update(frame, boxes(*((k * 200 + 40 * np.sin(frame / 10), 100 * k, 80, 90) for k in seen)), np.full(len(seen), 0.9), 1280, 720)
        assert [i for i, *_ in shown] == [t.id for t in t.tracks if not t.lost]
    assert not calls and t.next_id == 7


def test_touching_boxes_are_all_pairs_that_overlap():
    rng = np.random.default_rng(2)
    for n, m in ((0, 3), (3, 0), (1, 1), (30, 40)):
        a, b = (np.column_stack([rng.uniform(0, 300, (k, 2)), rng.uniform(1, 120, (k, 2))]) for k in (n, m))
        iou = np.zeros((n, m))
        for i, j, v in K.touching(a.tolist(), b.tolist()):
            iou[i, j] = v
        assert np.allclose(iou, K.overlap(a, b))


def test_track_grows_with_its_detection():
    t = K.ByteTracker(iou=0.1)
    t.update(1, boxes((100, 100, 80, 180)), np.array([0.9]))
    out = t.update(2, boxes((100, 100, 300, 300)), np.array([0.9]))
    assert out[0][0] == 1 and out[0][1][2] > 116


def test_frame_zero_and_one_are_one_frame():
    t = K.ByteTracker()
    t.update(0, boxes((0, 0, 20, 20)), np.array([0.9]))
    assert t.frame == 1


def test_demo_tracker_shows_missed_boxes_as_occluded():
    t = K.DemoTracker(least_hits=1)
    t.update(1, boxes((0, 0, 50, 50)), np.array([0.9]))
    (shown,) = t.update(2, np.zeros((0, 4)), np.zeros(0))
    assert shown[0] == 1 and shown[3]


def test_simplified_line():
    line = np.array([(0, 0), (1, 0.1), (2, 0), (2, 5), (2, 9)], float)
    assert K.simplified(line, 1.0).tolist() == [[0, 0], [2, 0], [2, 9]]
    assert len(K.simplified(line, 0)) == 5


OBS = "stream_id string, profile string, frame_id bigint, pts_ns bigint, ts_ms bigint, width int, height int, track_id bigint, x double, y double, w double, h double, score double"
RULE = "id string, stream_id string, profile string, kind string, name string, enabled boolean, geometry string, settings string, created_at_ms bigint, updated_at_ms bigint"


def observed(spark, rows):
    return spark.createDataFrame([("cam0", "ui", f, f * 1_000_000_000, ts, 120, 100, t, float(x), 20.0, 10.0, 20.0, 0.9) for f, ts, t, x in rows], OBS)


def test_crossings_of_two_lines_by_two_tracks(spark):
    """A slanted line with a short gap and a short one that is only touched; one track goes to and fro, one slips past the short line's end."""
    rules = spark.createDataFrame([
        ("slant", "cam0", "ui", "line", "slant", True, '{"start":[0,0],"end":[120,100]}', '{"debounce_ms":700}', 1, 1), ("short", "cam0", "ui", "line", "short", True, '{"p1":{"x":90,"y":30},"p2":{"x":90,"y":39}}', "{}", 2, 2),
    ], RULE)
    to_and_fro = [(k, 250 * k, 3, 20 if k % 2 else 75) for k in range(1, 9)]
    seen = observed(spark, to_and_fro + [(k, 250 * k, 4, 60 + 5 * k) for k in range(1, 9)])
    got = sorted((r.rule_id, r.track_id, r.ts_ms, r.direction) for r in A.line_events(seen, rules).collect())
    slant = [g for g in got if g[0] == "slant"]
    ways = {d: [t for _, track, t, way in slant if track == 3 and way == d] for d in ("negative_to_positive", "positive_to_negative")}
    # each way comes every 500 ms, of which those 700 ms apart or more stay
    assert sorted(ways.values()) == [[500, 1500], [750, 1750]]
    assert not [g for g in slant if g[1] == 4]
    touched = [g for g in got if g[0] == "short"]
    assert touched == [("short", 4, 1250, "on_line")]


def test_stays_of_two_tracks_in_a_triangle(spark):
    """One track walks through, is told once and lost inside on its second visit; the other is inside from its first frame and stays."""
    corners = '{"polygon":[[30,0],[100,0],[65,100]]}'
    rule = spark.createDataFrame([("tri", "cam0", "ui", "area", "tri", True, corners, '{"dwell_threshold_s":0.75}', 1, 1)], RULE)
    first = [(1, 100, 1, 0), (2, 600, 1, 50), (3, 1100, 1, 55), (4, 1600, 1, 60), (5, 2100, 1, 110), (6, 2600, 1, 52), (7, 3100, 1, 56)]
    second = [(k, 500 * k - 400, 2, 58) for k in range(1, 9)]
    got = {1: [], 2: []}
    for r in A.area_events(observed(spark, first + second), rule).orderBy("frame_id").collect():
        got[r.track_id].append((r.kind.removeprefix("area_"), r.frame_id, r.dwell_s, r.total_dwell_s))
    assert got[1] == [("enter", 2, None, None), ("dwell_threshold", 4, 1.0, None), ("exit", 5, 1.5, 1.5), ("enter", 6, None, None), ("exit", 8, 1.0, 2.5)]
    assert got[2] == [("enter", 1, None, None), ("dwell_threshold", 3, 1.0, None)]


def test_ways_there_and_back_are_one_route(spark):
    """Two there, one back, one elsewhere, and one that is still under way."""
    walk = lambda start, track, xs: [(start + k, 1000 * (start + k), track, x) for k, x in enumerate(xs)]
    seen = observed(spark, walk(1, 1, (10, 40, 90)) + walk(5, 2, (12, 92)) + walk(9, 3, (91, 50, 11)) + walk(14, 4, (10, 30)) + walk(20, 5, (10, 90)))
    routes = [(r.n_points, r.support) for r in K.routes(A.route_points(seen, eps=2.0), eps=2.0).collect()]
    assert sorted(routes) == [(2, 1), (2, 3)]


def test_a_way_meets_few_routes_however_many_there_are():
    """Of 10,000 routes that all begin on one place, a way is compared with those that end near its own end."""

    class Counted(list):
        reads = 0

        def __getitem__(self, k):
            self.reads += 1
            return super().__getitem__(k)

    known = K.Routes(30.0)
    known.ends = Counted()
    for k in range(10_000):
        known.add(boxes((5, 5), (100 + k % 100 * 40, 100 + k // 100 * 40)), k)
    assert len(known.points) == 10_000
    known.ends.reads = 0
    assert known.first_near(6, 5, 100 + 77 * 40, 100 + 50 * 40) == known.first_near(100 + 77 * 40, 100 + 50 * 40, 6, 5) == 5077
    assert known.ends.reads < 40


def test_polygon_of_two_corners_holds_nothing(spark):
    df = spark.sql("SELECT array(struct(0.0D AS x, 0.0D AS y), struct(10.0D AS x, 10.0D AS y)) AS p, 5.0D AS x, 5.0D AS y")
    assert df.select(G.in_polygon(df.p, df.x, df.y)).first()[0] is False


def test_long_sequences_cut_into_spans_agree_with_one_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wayline.operators.sequence import with_previous, with_running_sum

    df = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("o"), (F.col("id") % 11).alias("v"))
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", "v", F.lag("v").over(w).alias("prev_v"), F.sum("v").over(w).alias("s")).collect()
    got = with_running_sum(with_previous(df, ["k"], "o", ["v"], span=50), ["k"], "o", F.col("v"), "s", span=64).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def run_stream(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streamed_tracker_equals_batch(spark, tmp_path):
    det = X.detections(spark, SF)
    for k, cut in enumerate(("frame_id < 20", "frame_id >= 20")):
        det.filter(cut).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in det.schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = run_stream(live.tracked(stream, idle_ms=None), "tracked").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, K.track(det).collect()))


def test_streamed_debounce_equals_batch(spark, tmp_path):
    cand = A.line_candidates(X.track_obs(spark, SF), X.rules(spark)).select("stream_id", "rule_id", "track_id", "direction", "ts_ms", "gap_ms")
    cand.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.read(spark, f"{tmp_path}/in", "stream_id string, rule_id string, track_id bigint, direction string, ts_ms bigint, gap_ms bigint")
    got = run_stream(live.debounced(stream, idle_ms=None), "debounced").collect()
    want = A.line_events(X.track_obs(spark, SF), X.rules(spark)).select("stream_id", "rule_id", "track_id", "direction", "ts_ms").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_streamed_area_events_equal_batch(spark, tmp_path):
    obs = X.track_obs(spark, SF)
    for k, cut in enumerate(("frame_id < 20", "frame_id >= 20")):
        obs.filter(cut).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in obs.schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = run_stream(live.area_events(stream, X.rules(spark), idle_ms=None), "area_events")
    want = A.area_events(obs, X.rules(spark))
    rows = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*want.columns).collect()), key=repr)
    assert rows(got) == rows(want) and len(rows(want)) > 50


def test_streamed_windows_and_tables(spark, tmp_path):
    obs = X.track_obs(spark, SF)
    obs.coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in obs.schema)
    sink = live.to_tables(f"{tmp_path}/out", {"samples": lambda b: A.with_foot(b), "counts": lambda b: A.counts(b)})
    q = live.once(live.read(spark, f"{tmp_path}/in", schema)).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/samples").count() == obs.count()
    windows = run_stream(live.occupancy(live.read(spark, f"{tmp_path}/in", schema), "2 seconds", "1 second"), "windows")
    assert windows.count() > 0

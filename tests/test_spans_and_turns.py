"""State machines in spans, arrivals in turn and rules with a history against plain loops."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import analytics as A
from wayline.operators import arrivals, detect, rule_history
from wayline.operators.sequence import gate_table, gated, with_last
from wayline.plans.queries import QUERIES
from wayline.sources import fixtures as X

SF = "/root/testdata/sf0.001"
OBS = "stream_id string, profile string, frame_id bigint, pts_ns bigint, ts_ms bigint, width int, height int, track_id bigint, x double, y double, w double, h double, score double"
RULE = "id string, stream_id string, profile string, kind string, name string, enabled boolean, geometry string, settings string, created_at_ms bigint, updated_at_ms bigint"


def plain_gate(rows):
    """(time, gap) in order: kept if it stands its gap beyond the last kept."""
    kept = []
    for t, gap in sorted(rows):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("span", [1, 7, 100, 10_000])
def test_gates_in_spans(spark, span):
    rng = random.Random(span)
    rows = [("hot", rng.randrange(3000), rng.choice([0, 5, 40, 900])) for _ in range(1500)] + [(f"k{k}", rng.randrange(900), 30) for k in range(8) for _ in range(40)] + [("one", 5, 10)]
    got = defaultdict(list)
    for r in gated(spark.createDataFrame(rows, "k string, t bigint, g int"), ["k"], "t", F.col("g"), span).collect():
        got[r.k].append(r.t)
    for k in {r[0] for r in rows}:
        assert sorted(got[k]) == plain_gate([(t, g) for key, t, g in rows if key == k])


def test_table_of_a_span_tells_what_any_gate_leaves():
    rng = random.Random(2)
    for _ in range(200):
        times = sorted(rng.randrange(50, 120) for _ in range(rng.randrange(1, 15)))
        rows = [(t, rng.choice([0, 3, 20, 60])) for t in times]
        rows.sort()
        reached, last = gate_table(np.array([t for t, _ in rows]), np.array([g for _, g in rows]))
        for before in range(-30, rows[0][0]):
            kept = [before]
            for t, g in rows:
                if t - kept[-1] >= g:
                    kept.append(t)
            at = int(np.searchsorted(reached, before))
            assert (int(last[at]) if at < len(reached) else before) == kept[-1]


def plain_stays(rows, frames, threshold):
    """Events of one track and area: rows {frame: (ts, inside)}, the stream's frames [(frame, ts)]."""
    entered, told, total, events = None, False, 0.0, []
    for frame, ts in frames:
        if frame not in rows:
            if entered is not None:
                total += max(0, ts - entered) / 1000
                events.append(("area_exit", frame, ts, max(0, ts - entered) / 1000, total))
                entered = None
            continue
        inside = rows[frame]
        if inside and entered is None:
            entered, told = ts, False
            events.append(("area_enter", frame, ts, None, None))
        elif inside:
            spent = max(0, ts - entered) / 1000
            if threshold is not None and spent >= threshold and not told:
                told = True
                events.append(("area_dwell_threshold", frame, ts, spent, None))
        elif entered is not None:
            total += max(0, ts - entered) / 1000
            events.append(("area_exit", frame, ts, max(0, ts - entered) / 1000, total))
            entered = None
    return events


@pytest.mark.parametrize("span", [1, 2, 5, 16, 4096])
def test_stays_in_spans(spark, span):
    """Long and short stays, losses, times that go back, thresholds of 0 and none, by a loop over frames."""
    rng = random.Random(8)
    areas = {"left": (0.0, 400.0, 0.9), "right": (600.0, 1280.0, None), "all": (-10.0, 1300.0, 0.0), "wide": (100.0, 1200.0, 6.0)}
    frames, obs, at = [], [], 1000
    for frame in sorted(rng.sample(range(200), 120)):
        at += rng.choice([200, 200, 400, -100, 1500])
        frames.append((frame, at))
    place = {t: rng.random() * 1200 for t in range(4)}
    for frame, ts in frames:
        for track in place:
            place[track] = min(1240.0, max(0.0, place[track] + rng.gauss(0, 160)))
            if rng.random() > (0.1 if track else 0.02):
                obs.append(("cam", "ui", frame, frame * 10**9, ts, 1280, 720, track, place[track], 300.0, 10.0, 20.0, 0.9))
    # a frame that holds no other track is still one of the stream
    obs += [("cam", "ui", f, f * 10**9, ts, 1280, 720, 99, 1270.0, 700.0, 4.0, 4.0, 0.9) for f, ts in frames]
    corners = lambda a, b: json.dumps({"points": [[a, 0], [b, 0], [b, 720], [a, 720]]})
    rules = [(i, "cam", "ui", "area", i, True, corners(a, b), json.dumps({} if t is None else {"dwell_threshold_s": t}), 1, 1) for i, (a, b, t) in areas.items()]
    got = defaultdict(list)
    for r in A.area_events(spark.createDataFrame(obs, OBS), spark.createDataFrame(rules, RULE), span).collect():
        got[r.track_id, r.rule_id].append((r.kind, r.frame_id, r.ts_ms, r.dwell_s, r.total_dwell_s))
    for track in place:
        for rule, (a, b, threshold) in areas.items():
            rows = {o[2]: a < o[8] + 5 < b for o in obs if o[7] == track}
            want = plain_stays(rows, frames, threshold)
            plain = [(k, f, t, None if d is None else round(d, 3), None if s is None else round(s, 3)) for k, f, t, d, s in want]
            assert sorted(got[track, rule], key=lambda e: (e[1], e[0] != "area_exit")) == sorted(plain, key=lambda e: (e[1], e[0] != "area_exit")), (track, rule)


def test_a_busy_track_is_many_tasks(spark):
    """The rows of one track over many spans are dealt to as many partitions as there are."""
    obs = spark.range(4000).selectExpr("'cam' AS stream_id", "'ui' AS profile", "id AS frame_id", "id * 1000000000 AS pts_ns", "id * 100 AS ts_ms", "1280 AS width", "720 AS height", "7L AS track_id", "300.0D + id % 2 AS x", "300.0D AS y", "10.0D AS w", "20.0D AS h", "0.9D AS score")
    rules = spark.createDataFrame([("r", "cam", "ui", "area", "r", True, '{"points":[[0,0],[900,0],[900,720],[0,720]]}', '{"dwell_threshold_s":350}', 1, 1)], RULE)
    (enter, told) = sorted(A.area_events(obs, rules, 50).collect(), key=lambda r: r.frame_id)
    assert (enter.kind, told.kind, told.frame_id, told.dwell_s) == ("area_enter", "area_dwell_threshold", 3500, 350.0)
    cut = obs.select("track_id", F.floor(F.col("frame_id") / 50).alias("span")).repartition(8, "track_id", "span")
    assert cut.select(F.spark_partition_id().alias("p")).distinct().count() >= 6


@pytest.mark.parametrize("span", [1, 9, 4096])
def test_last_points_of_ways_whatever_the_span(spark, span):
    obs = X.track_obs(spark, SF)
    every = {(r.stream_id, r.track_id, r.episode): (r.lost_frame_id, [tuple(p) for p in r.points]) for r in A.route_points(obs, most=10**6).collect()}
    assert max(len(p) for _, p in every.values()) > 5
    for most in (1, 2, 5):
        got = {(r.stream_id, r.track_id, r.episode): (r.lost_frame_id, [tuple(p) for p in r.points]) for r in A.route_points(obs, most=most, span=span).collect()}
        assert got == {k: (lost, p[-most:]) for k, (lost, p) in every.items()}


def plain_turns(rows, window, most):
    """(frame, arrival, boxes' arrival, out at) by looking at all that waits after every arrival."""
    turn, frames, boxes, out = None, {}, {}, []
    for is_frame, number, at in rows:
        (frames if is_frame else boxes)[number] = at
        if turn is None and frames:
            turn = min(frames)
        going = turn is not None
        while going:
            going = False
            newest = max([turn, *frames, *boxes]) if frames and boxes else max([*frames] or [turn])
            if frames and boxes:
                newest = max(max(frames), max(boxes))
            if turn in frames and turn in boxes:
                out.append((turn, frames.pop(turn), boxes.pop(turn), at))
                turn, going = turn + 1, True
            elif turn not in frames:
                if frames and min(frames) > turn:
                    turn, going = min(frames), True
            elif newest - turn > window:
                out.append((turn, frames.pop(turn), None, at))
                turn, going = turn + 1, True
        for held in (frames, boxes):
            for number in sorted(held)[: max(0, len(held) - most)]:
                del held[number]
    return out


@pytest.mark.parametrize("window, most, mess", [(5, 500, 3), (5, 4, 12), (0, 500, 6), (2, 1, 2)])
def test_frames_in_turn_by_plain_loops(spark, window, most, mess):
    rng = random.Random(window * 100 + most)
    rows = []
    for s in range(3):
        # frames out of turn, and some again, in the third stream only: one that waits in vain holds up all that lack a turn
        came = [(True, f, f + rng.random() * (mess if s == 2 else 1)) for f in range(150) if rng.random() > 0.1] + [(False, f, f + 1 + rng.random() * mess * 2) for f in range(150) if rng.random() > 0.2]
        came += [(True, f, f + 20) for f in range(0, 150, 40)] if s == 2 else []
        rows += [(f"cam{s}", k, is_frame, f) for k, (is_frame, f, _) in enumerate(sorted(came, key=lambda c: c[2]))]
    df = spark.createDataFrame(rows, "stream_id string, arrival bigint, is_frame boolean, frame_id bigint").repartition(5)
    got = defaultdict(list)
    for r in arrivals.frames_in_turn(df, window, most).collect():
        got[r.stream_id].append((r.frame_id, r.arrival, r.boxes_arrival, r.out_at))
    for s in {r[0] for r in rows}:
        want = plain_turns([(is_frame, f, k) for stream, k, is_frame, f in rows if stream == s], window, most)
        assert sorted(got[s]) == sorted(want) and len(want) > (0 if s == "cam2" else 10)
        assert [x[0] for x in sorted(got[s], key=lambda x: (x[3], x[0]))] == [x[0] for x in want]


def test_frames_of_the_table_in_turn(spark):
    came, got = defaultdict(list), defaultdict(list)
    for r in X.arrivals(spark, SF).orderBy("arrival").collect():
        came[r.stream_id].append((r.is_frame, r.frame_id, r.arrival))
    boxes = {(r.stream_id, r.frame_id): r.n for r in X.detections(spark, SF).groupBy("stream_id", "frame_id").agg(F.count("*").alias("n")).collect()}
    for r in QUERIES["frame_detection_in_turn"](spark, SF).collect():
        got[r.stream_id].append((r.frame_id, r.arrival, r.boxes_arrival, r.out_at))
        assert r.n_boxes == (boxes[r.stream_id, r.frame_id] if r.boxes_arrival is not None else 0)
    for s, rows in came.items():
        want = plain_turns(rows, 5, 500)
        assert sorted(got[s]) == sorted(want)
        assert any(w[2] is None for w in want) and any(w[2] is not None for w in want)


def plain_pairs(rows, most):
    """Two lists that are looked through after every arrival: (side, pts, frame) in order."""
    held, out = ([], []), []

    def pairs():
        while True:
            hit = next(((i, j) for i, a in enumerate(held[0]) for j, b in enumerate(held[1]) if a[0] > 0 and a[0] == b[0]), None)
            if hit is None and held[0] and held[1] and held[0][0][0] <= 0 and held[1][0][0] <= 0:
                hit = (0, 0)
            if hit is None:
                return
            a, b = held[0].pop(hit[0]), held[1].pop(hit[1])
            out.append((a[1], b[1], a[0] if a[0] > 0 else b[0]))

    for side, pts, frame in rows:
        held[side].append((pts, frame))
        pairs()
        for h in held:
            del h[: max(0, len(h) - most)]
        while held[0] and held[1]:
            a, b = held[0][0][0], held[1][0][0]
            if min(a, b) <= 0 or a == b:
                break
            a_has, b_has = a in [p for p, _ in held[1]], b in [p for p, _ in held[0]]
            if not a_has and (b_has or a < b):
                held[0].pop(0)
            elif not b_has and (a_has or b < a):
                held[1].pop(0)
            else:
                break
        pairs()
    return out


@pytest.mark.parametrize("most", [1, 3, 8])
def test_pairs_in_turn_by_plain_loops(spark, most):
    came, got = defaultdict(list), defaultdict(list)
    df = X.sides(spark, SF)
    for r in df.orderBy("arrival").collect():
        came[r.stream_id].append((r.side, r.pts_ns, r.frame_id))
    for r in arrivals.paired_in_turn(df, most).collect():
        got[r.stream_id].append((r.frame_id, r.ui_frame_id, r.pts_ns))
    lost = 0
    for s, rows in came.items():
        want = plain_pairs(rows, most)
        assert sorted(got[s]) == sorted(want)
        lost += len(rows) // 2 - len(want)
    assert lost > 0


def plain_history(changes):
    """Versions by putting changes into a dict, rule by rule."""
    out = []
    for rule, rows in changes.items():
        now, mine = None, []
        for c in sorted(rows, key=lambda c: c.seq):
            fields = {f: c[f] for f in rule_history.FIELDS if c[f] is not None}
            if c.op == "put":
                now = {**fields, "created": now["created"] if now else c.at_ms}
            elif now is None:
                continue
            elif c.op == "patch":
                now = {**now, **fields}
            else:
                now = None
            if mine and mine[-1][-1] is None:
                mine[-1][-1] = c.at_ms
            if now:
                mine.append([*rule, c.seq, *(now[f] for f in rule_history.FIELDS), now["created"], c.at_ms, None])
        out += mine
    return sorted(map(tuple, out))


@pytest.mark.parametrize("span", [1, 30, 4096])
def test_versions_by_plain_dicts(spark, span, monkeypatch):
    from wayline.operators import sequence

    for f in (sequence.with_last, sequence.with_previous):
        monkeypatch.setattr(f, "__defaults__", tuple(span if d == 4096 else d for d in f.__defaults__))
    changes = X.rule_changes(spark, SF)
    rows = defaultdict(list)
    for c in changes.collect():
        rows[c.stream_id, c.profile, c.id].append(c)
    got = rule_history.versions(changes).select(*rule_history.RULE, "seq", *rule_history.FIELDS, "created_at_ms", "valid_from_ms", "valid_to_ms").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_history(rows), key=repr)


@pytest.mark.parametrize("bucket", [500, 10_000, 10**9])
def test_crossings_follow_the_version(spark, bucket):
    """A line that moves, is switched off and comes back; the gap of the time counts."""
    at = lambda x: json.dumps({"points": [[x, 0], [x, 700]]})
    gap = lambda ms: json.dumps({"min_gap_ms": ms})
    changes = [
        (1, 0, "put", "line", "a", True, at(100), gap(1)), (2, 4000, "patch", None, None, None, at(500), None), (3, 8000, "patch", None, None, False, None, None),
        (4, 12_000, "patch", None, None, True, None, gap(3000)), (5, 20_000, "delete", None, None, None, None, None), (6, 21_000, "patch", None, None, None, at(100), None),
    ]
    table = spark.createDataFrame([("cam", "ui", "r", *c) for c in changes], "stream_id string, profile string, id string, seq bigint, at_ms bigint, op string, kind string, name string, enabled boolean, geometry string, settings string")
    # a walk that crosses 100 and 500 each second
    obs = spark.createDataFrame([("cam", "ui", f, f * 10**9, f * 1000, 1280, 720, 1, 595.0 if f % 2 else 5.0, 300.0, 10.0, 20.0, 0.9) for f in range(26)], OBS)
    past = rule_history.versions(table)
    found = sorted((r.ts_ms, r.valid_from_ms) for r in rule_history.line_candidates(obs, past, bucket).collect())
    assert found == [(t, 0 if t < 4000 else 4000) for t in range(1000, 8000, 1000)] + [(t, 12_000) for t in range(12_000, 20_000, 1000)]
    events = defaultdict(list)
    for r in rule_history.line_events(obs, past, bucket).collect():
        events[r.direction].append(r.ts_ms)
    want = lambda first: plain_gate([(t, 3000 if t >= 12_000 else 1) for t, _ in found if t % 2000 == first])
    assert sorted(map(sorted, events.values())) == sorted([want(0), want(1000)])
    assert rule_history.in_force(past).count() == 0 and rule_history.in_force(past, 5000).first().geometry == at(500)


def test_events_of_versions_by_plain_loops(spark):
    found, got = defaultdict(list), defaultdict(list)
    key = lambda r: (r.stream_id, r.track_id, r.rule_id, r.direction)
    for r in QUERIES["line_cross_versions"](spark, SF).collect():
        found[key(r)].append((r.ts_ms, r.gap_ms))
    for r in QUERIES["line_events_versions"](spark, SF).collect():
        got[key(r)].append(r.ts_ms)
    assert len(found) > 50 and {k: sorted(v) for k, v in got.items()} == {k: plain_gate(v) for k, v in found.items()}


def test_last_values_in_spans(spark):
    df = spark.createDataFrame([("k", i, i % 4 or None, i % 7 or None) for i in range(60)], "k string, o bigint, a bigint, b bigint")
    for inclusive in (True, False):
        rows = with_last(df, ["k"], "o", {"a": F.col("a"), "z": F.when(F.col("b") == 3, F.col("o"))}, inclusive, span=5).orderBy("o").collect()
        a = z = None
        for r in rows:
            if not inclusive:
                assert (r.a, r.z) == (a, z)
            a, z = r.o % 4 or a, r.o if r.o % 7 == 3 else z
            if inclusive:
                assert (r.a, r.z) == (a, z)


def test_layouts_of_a_head(spark):
    v = [[float(10 * r + k) for k in range(6)] for r in range(4)]
    flat = [x for row in v for x in row]
    rows = [
        ("matrix", flat, 2, 6, 4, 1, None), ("columns", [v[r][k] for k in range(6) for r in range(4)], 2, 4, 6, 1, None), ("channels", flat, 3, 6, 2, 2, None),
        ("padded", [*flat[:12], 0.0, 0.0, *flat[12:], 0.0, 0.0], 3, 6, 2, 2, 14), ("flat", [*flat, 1.0, 2.0], 1, 26, 1, 1, None), ("deep", flat, 3, 12, 2, 1, None),
        ("square", [float(k) for k in range(36)], 2, 6, 6, 1, None), ("short", [1.0] * 5, 2, 6, 0, 1, None), ("none", None, 2, 6, 1, 1, None), ("empty", [], 1, 0, 1, 1, None),
    ]
    got = {r.name: r.rows for r in detect.head_rows(spark.createDataFrame(rows, "name string, data array<float>, dims int, w int, h int, c int, channel_step int")).collect()}
    for name in ("matrix", "columns", "channels", "padded", "flat", "deep"):
        assert got[name] == v, name
    assert got["square"] == [[float(6 * r + k) for k in range(6)] for r in range(6)]
    assert got["short"] == got["none"] == got["empty"] == []


@pytest.mark.parametrize("anchors", [1, 2])
def test_places_of_a_head_are_told_from_their_number(spark, anchors):
    want = [(s, x, y) for s in (8, 16, 32) for y in range(96 // s) for x in range(160 // s) for _ in range(anchors)]
    at = spark.range(-1, len(want) + 1).select("id", detect.head_place(F.col("id"), 160, 96, anchors=anchors).alias("p")).orderBy("id").collect()
    assert [r.p and tuple(r.p) for r in at] == [None, *want, None]


@pytest.mark.parametrize("name", ["yolox_decode", "yunet_decode", "scrfd_decode", "tensor_rows"])
def test_decoding_tells_no_list_again_for_each_row(spark, name):
    """Neither all places of a head for one of them, nor a head's outputs in a filter under their explode."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert "array_repeat(struct(stride" not in plan and not any("lambda" in line for line in filters)


def test_segments_meet_few_versions_that_are_not_in_force(spark):
    where = "/root/testdata/sf0.01"
    lines = A.line_rules(rule_history.versions(X.rule_changes(spark, where)), "valid_from_ms", "valid_to_ms").collect()
    ends = A.segments(X.track_obs(spark, where)).select("stream_id", "to_ts_ms").collect()
    b = getattr(rule_history, "BUCKET_MS", 10_000)
    spans = [(v.stream_id, v.valid_from_ms, v.valid_to_ms or 2**62) for v in lines]
    met = sum(s == r.stream_id and a // b <= r.to_ts_ms // b <= (z - 1) // b for r in ends[::20] for s, a, z in spans)
    live = sum(s == r.stream_id and a <= r.to_ts_ms < z for r in ends[::20] for s, a, z in spans)
    assert 0 < live <= met < 2 * live

"""Each query of the catalogue as SQL over the driver's tables, for comparison. Queries with grouped state or folds that SQL lacks have none."""

from __future__ import annotations

_OBS = """
obs AS (
  SELECT stream_id, 'ui' AS profile, frame_id, pts_ns, 1704067200000 + CAST(floor(pts_ns / 1000000) AS BIGINT) AS ts_ms, 1280 AS width, 720 AS height, track_id,
         CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, score
  FROM (SELECT concat('cam', CAST(user_id % 3 AS STRING)) AS stream_id, CAST(floor(event_id / 20) AS BIGINT) AS frame_id,
               CAST(floor(event_id / 20) AS BIGINT) * 200000000 + CAST(floor(event_id / 1000) AS BIGINT) * 3000000000 AS pts_ns,
               CAST(floor((user_id % 15) / 3) AS BIGINT) + 1 AS track_id, (event_id * 7919) % 1240 AS x, (event_id * 104729) % 640 AS y, 20 + user_id % 60 AS w, 40 + event_id % 120 AS h,
               CAST(30 + event_id % 70 AS DOUBLE) / 100 AS score,
               row_number() OVER (PARTITION BY user_id % 3, floor(event_id / 20), floor((user_id % 15) / 3) ORDER BY event_id DESC) AS rn
        FROM events) t WHERE rn = 1),
fr AS (
  SELECT *, lag(frame_id) OVER w AS prev_frame_id, lead(frame_id) OVER w AS next_frame_id, lead(ts_ms) OVER w AS next_ts_ms, row_number() OVER w AS frame_no,
         CASE WHEN pts_ns > lag(pts_ns) OVER w THEN LEAST((pts_ns - lag(pts_ns) OVER w) / CAST(1e9 AS DOUBLE), CAST(1 AS DOUBLE))
              WHEN ts_ms > lag(ts_ms) OVER w THEN LEAST((ts_ms - lag(ts_ms) OVER w) / CAST(1e3 AS DOUBLE), CAST(1 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS delta_s
  FROM (SELECT stream_id, profile, frame_id, max(pts_ns) AS pts_ns, max(ts_ms) AS ts_ms, max(width) AS width, max(height) AS height FROM obs GROUP BY ALL)
  WINDOW w AS (PARTITION BY stream_id, profile ORDER BY frame_id)),
f AS (
  SELECT obs.*, x + w / 2 AS foot_x, y + h * CAST(0.95 AS DOUBLE) AS foot_y, delta_s, frame_no, next_frame_id, next_ts_ms
  FROM obs JOIN fr USING (stream_id, profile, frame_id)),
o AS (
  SELECT *, lag(foot_x) OVER t AS px, lag(foot_y) OVER t AS py, lag(ts_ms) OVER t AS prev_ts, lag(frame_no) OVER t AS prev_no
  FROM f WINDOW t AS (PARTITION BY stream_id, profile, track_id ORDER BY frame_id)),
seg AS (
  SELECT stream_id, profile, track_id, frame_id, prev_ts AS from_ts_ms, ts_ms AS to_ts_ms, px AS x1, py AS y1, foot_x AS x2, foot_y AS y2, delta_s,
         CASE WHEN delta_s > 0 THEN sqrt((foot_x - px) * (foot_x - px) + (foot_y - py) * (foot_y - py)) / delta_s ELSE CAST(0 AS DOUBLE) END AS speed_px_s
  FROM o WHERE prev_ts IS NOT NULL)
"""
_DIRECTION = "CASE WHEN s1 = 0 OR s2 = 0 THEN 'on_line' WHEN s1 < 0 AND s2 > 0 THEN 'negative_to_positive' WHEN s1 > 0 AND s2 < 0 THEN 'positive_to_negative' END"
_CROSSED = """
met AS (
  SELECT * FROM sides
  WHERE (sign(o1) * sign(o2) < 0 AND sign(s1) * sign(s2) < 0)
     OR (abs(o1) <= 1e-9 AND ax BETWEEN LEAST(x1, x2) - 1e-9 AND GREATEST(x1, x2) + 1e-9 AND ay BETWEEN LEAST(y1, y2) - 1e-9 AND GREATEST(y1, y2) + 1e-9)
     OR (abs(o2) <= 1e-9 AND bx BETWEEN LEAST(x1, x2) - 1e-9 AND GREATEST(x1, x2) + 1e-9 AND b_y BETWEEN LEAST(y1, y2) - 1e-9 AND GREATEST(y1, y2) + 1e-9)
     OR (abs(s1) <= 1e-9 AND x1 BETWEEN LEAST(ax, bx) - 1e-9 AND GREATEST(ax, bx) + 1e-9 AND y1 BETWEEN LEAST(ay, b_y) - 1e-9 AND GREATEST(ay, b_y) + 1e-9)
     OR (abs(s2) <= 1e-9 AND x2 BETWEEN LEAST(ax, bx) - 1e-9 AND GREATEST(ax, bx) + 1e-9 AND y2 BETWEEN LEAST(ay, b_y) - 1e-9 AND GREATEST(ay, b_y) + 1e-9))
"""
_LINES = """
lines(rule_id, ax, ay, bx, b_y) AS (VALUES ('line-mid', CAST(640 AS DOUBLE), CAST(0 AS DOUBLE), CAST(640 AS DOUBLE), CAST(720 AS DOUBLE)), ('line-diag', 0, 0, 1280, 720)),
sides AS (
  SELECT seg.*, rule_id, (bx - ax) * (y1 - ay) - (b_y - ay) * (x1 - ax) AS s1, (bx - ax) * (y2 - ay) - (b_y - ay) * (x2 - ax) AS s2,
         (x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1) AS o1, (x2 - x1) * (b_y - y1) - (y2 - y1) * (bx - x1) AS o2, ax, ay, bx, b_y
  FROM seg, lines),""" + _CROSSED + f""",
cand AS (SELECT stream_id, profile, track_id, rule_id, frame_id, to_ts_ms AS ts_ms, x2 AS x, y2 AS y, {_DIRECTION} AS direction FROM met),
crossed AS (SELECT * FROM cand WHERE direction IS NOT NULL),
timed AS (
  SELECT stream_id, profile, track_id, rule_id, direction, list_sort(list(ts_ms)) AS ats FROM crossed GROUP BY ALL),
kept AS (
  SELECT stream_id, profile, track_id, rule_id, direction, ats[1] AS ts_ms, ats FROM timed
  UNION ALL
  SELECT stream_id, profile, track_id, rule_id, direction, list_min(list_filter(ats, lambda t: t >= ts_ms + 1000)) AS ts_ms, ats FROM kept
  WHERE len(list_filter(ats, lambda t: t >= ts_ms + 1000)) > 0),
ev AS (
  SELECT stream_id, profile, track_id, rule_id, direction, ts_ms, row_number() OVER (PARTITION BY stream_id, profile ORDER BY ts_ms, track_id, rule_id, direction) AS id FROM kept)
"""
_AREAS = """
edges(rule_id, cx, cy, qx, qy) AS (VALUES
  ('area-rect', CAST(320 AS DOUBLE), CAST(180 AS DOUBLE), CAST(320 AS DOUBLE), CAST(540 AS DOUBLE)), ('area-rect', 960, 180, 320, 180), ('area-rect', 960, 540, 960, 180), ('area-rect', 320, 540, 960, 540),
  ('area-tri', 100, 100, 640, 700), ('area-tri', 1200, 100, 100, 100), ('area-tri', 640, 700, 1200, 100)),
areas(rule_id, threshold_s) AS (VALUES ('area-rect', CAST(0.4 AS DOUBLE)), ('area-tri', NULL), ('area-bad', NULL)),
ep AS (SELECT *, SUM(CASE WHEN prev_no IS NULL OR frame_no - prev_no > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, profile, track_id ORDER BY frame_id) AS episode FROM o),
hits AS (
  SELECT stream_id, profile, track_id, frame_id, rule_id, COUNT(*) % 2 = 1 AS hit FROM ep, edges
  WHERE (cy > foot_y) <> (qy > foot_y) AND foot_x < (qx - cx) * (foot_y - cy) / (qy - cy) + cx GROUP BY ALL),
ins AS (
  SELECT ep.*, areas.rule_id, threshold_s, COALESCE(hit, false) AS inside FROM ep CROSS JOIN areas LEFT JOIN hits USING (stream_id, profile, track_id, frame_id, rule_id)),
st AS (
  SELECT *, COALESCE(lag(inside) OVER e, false) AS was, lead(frame_id) OVER e IS NULL AS is_last FROM ins WINDOW e AS (PARTITION BY stream_id, profile, track_id, rule_id, episode ORDER BY frame_id)),
sy AS (
  SELECT *, SUM(CASE WHEN inside AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, profile, track_id, rule_id ORDER BY frame_id) AS stay FROM st),
en AS (
  SELECT *, min(CASE WHEN inside AND NOT was THEN ts_ms END) OVER (PARTITION BY stream_id, profile, track_id, rule_id, stay) AS entered FROM sy WHERE inside OR was),
exits AS (
  SELECT *, SUM(dwell) OVER (PARTITION BY stream_id, profile, track_id, rule_id ORDER BY stay) AS total FROM (
    SELECT stream_id, profile, track_id, rule_id, stay, frame_id, ts_ms, foot_x, foot_y, (ts_ms - entered) / CAST(1000 AS DOUBLE) AS dwell FROM en WHERE was AND NOT inside
    UNION ALL
    SELECT stream_id, profile, track_id, rule_id, stay, next_frame_id, next_ts_ms, foot_x, foot_y, (next_ts_ms - entered) / CAST(1000 AS DOUBLE) FROM en WHERE inside AND is_last AND next_frame_id IS NOT NULL)),
th AS (
  SELECT *, (ts_ms - entered) / CAST(1000 AS DOUBLE) AS dwell, row_number() OVER (PARTITION BY stream_id, profile, track_id, rule_id, stay ORDER BY frame_id) AS n
  FROM en WHERE inside AND was AND threshold_s IS NOT NULL AND (ts_ms - entered) / CAST(1000 AS DOUBLE) >= threshold_s),
aev AS (
  SELECT stream_id, profile, track_id, rule_id, 'area_enter' AS kind, frame_id, ts_ms, foot_x, foot_y, CAST(NULL AS DOUBLE) AS dwell_s, CAST(NULL AS DOUBLE) AS total_dwell_s FROM en WHERE inside AND NOT was
  UNION ALL SELECT stream_id, profile, track_id, rule_id, 'area_dwell_threshold', frame_id, ts_ms, foot_x, foot_y, round(dwell, 3), NULL FROM th WHERE n = 1
  UNION ALL SELECT stream_id, profile, track_id, rule_id, 'area_exit', frame_id, ts_ms, foot_x, foot_y, round(dwell, 3), round(total, 3) FROM exits)
"""
_HEAT = """
clock AS (SELECT stream_id, profile, frame_id, delta_s, SUM(delta_s) OVER (PARTITION BY stream_id, profile ORDER BY frame_id) AS clock_s FROM fr),
heat AS (
  SELECT f.stream_id, f.profile,
         CAST(LEAST(floor(LEAST(GREATEST(foot_y, 0), height - 1e-6) / height * 36), 35) * 64 + LEAST(floor(LEAST(GREATEST(foot_x, 0), width - 1e-6) / width * 64), 63) AS BIGINT) AS cell,
         SUM(f.delta_s * pow(0.5, (end_s - clock_s) / 900)) AS value
  FROM f JOIN clock USING (stream_id, profile, frame_id) JOIN (SELECT stream_id, profile, max(clock_s) AS end_s FROM clock GROUP BY ALL) USING (stream_id, profile)
  WHERE f.delta_s > 0 GROUP BY ALL)
"""
_SNAPS = """
ts AS (SELECT stream_id, profile, list_sort(list(DISTINCT ts_ms)) AS ats FROM obs GROUP BY ALL),
snap AS (
  SELECT stream_id, profile, ats[1] AS ts_ms, ats FROM ts
  UNION ALL
  SELECT stream_id, profile, list_min(list_filter(ats, lambda t: t >= ts_ms + 500)) AS ts_ms, ats FROM snap WHERE len(list_filter(ats, lambda t: t >= ts_ms + 500)) > 0),
cnt AS (
  SELECT stream_id, profile, frame_id, active, CAST(SUM(COALESCE(new, 0)) OVER (PARTITION BY stream_id, profile ORDER BY frame_id) AS BIGINT) AS unique_tracks
  FROM (SELECT stream_id, profile, frame_id, COUNT(DISTINCT track_id) AS active FROM obs GROUP BY ALL)
  LEFT JOIN (SELECT stream_id, profile, frame_id, COUNT(*) AS new FROM (SELECT stream_id, profile, track_id, min(frame_id) AS frame_id FROM obs GROUP BY ALL) GROUP BY ALL) USING (stream_id, profile, frame_id)),
shot AS (SELECT cnt.*, fr.ts_ms FROM cnt JOIN fr USING (stream_id, profile, frame_id) JOIN snap ON snap.stream_id = cnt.stream_id AND snap.profile = cnt.profile AND snap.ts_ms = fr.ts_ms),
last AS (SELECT * FROM shot QUALIFY row_number() OVER (PARTITION BY stream_id, profile ORDER BY ts_ms DESC, frame_id DESC) = 1)
"""
_DET = """
det AS (
  SELECT concat('cam', CAST(s.sid AS STRING)) AS stream_id, f.frame_id, l.lane AS det_idx, 1280 AS width, 720 AS height,
         CAST((f.frame_id * 6 + l.lane * 220 + s.sid * 40) % 1200 AS DOUBLE) AS x, CAST(l.lane * 110 AS DOUBLE) AS y, CAST(80 AS DOUBLE) AS w, CAST(180 AS DOUBLE) AS h,
         CASE WHEN (f.frame_id + l.lane) % 9 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS score
  FROM (SELECT DISTINCT CAST(floor(event_id / 20) AS BIGINT) AS frame_id FROM events) f
  CROSS JOIN (VALUES (0), (1), (2)) AS s(sid) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS l(lane)
  WHERE (f.frame_id * 5 + l.lane * 3 + s.sid) % 11 <> 0),
crowd AS (
  SELECT * FROM det UNION ALL
  SELECT stream_id, frame_id, det_idx + 100, width, height, x + 10, y, w, h, score - CAST(0.05 AS DOUBLE) FROM det WHERE (frame_id + det_idx) % 4 = 0)
"""
_IOU = """CASE WHEN GREATEST(0, LEAST(a.x + a.w, b.x + b.w) - GREATEST(a.x, b.x)) * GREATEST(0, LEAST(a.y + a.h, b.y + b.h) - GREATEST(a.y, b.y)) > 0
  THEN GREATEST(0, LEAST(a.x + a.w, b.x + b.w) - GREATEST(a.x, b.x)) * GREATEST(0, LEAST(a.y + a.h, b.y + b.h) - GREATEST(a.y, b.y))
       / (a.w * a.h + b.w * b.h - GREATEST(0, LEAST(a.x + a.w, b.x + b.w) - GREATEST(a.x, b.x)) * GREATEST(0, LEAST(a.y + a.h, b.y + b.h) - GREATEST(a.y, b.y)))
  ELSE CAST(0 AS DOUBLE) END"""
_PAIRS = f"""
raw AS (SELECT a.stream_id, a.frame_id + 1 AS frame_id, a.det_idx AS track_idx, b.det_idx, b.score, {_IOU} AS iou FROM crowd a JOIN crowd b ON a.stream_id = b.stream_id AND a.frame_id + 1 = b.frame_id),
pairs AS (SELECT stream_id, frame_id, track_idx, det_idx, iou, 1 - iou AS cost, 1 - iou * score AS fused_cost FROM raw WHERE iou > 0)
"""
_GRID = """
cells AS (
  SELECT *, CAST(GREATEST(0, LEAST(floor(LEAST(GREATEST(y + h * CAST(0.95 AS DOUBLE), 0), height - 1) / height * 6), 5)) * 8 + GREATEST(0, LEAST(floor(LEAST(GREATEST(x + w / 2, 0), width - 1) / width * 8), 7)) AS BIGINT) AS cell FROM det),
mv AS (SELECT * FROM (SELECT *, lag(cell) OVER (PARTITION BY stream_id, det_idx ORDER BY frame_id) AS from_cell FROM cells) WHERE from_cell IS NOT NULL),
ends AS (SELECT stream_id, max(frame_id) AS e FROM det GROUP BY ALL),
occd0 AS (SELECT stream_id, cell, SUM(pow(CAST(0.92 AS DOUBLE), e - frame_id)) AS used FROM cells JOIN ends USING (stream_id) GROUP BY ALL),
occd AS (SELECT *, used / max(used) OVER (PARTITION BY stream_id) AS share FROM occd0),
trd0 AS (SELECT stream_id, from_cell, cell, COUNT(*) AS n, SUM(pow(CAST(0.98 AS DOUBLE), e - frame_id)) AS recent FROM mv JOIN ends USING (stream_id) GROUP BY ALL),
trd AS (SELECT *, recent / SUM(recent) OVER (PARTITION BY stream_id, from_cell) AS probability FROM trd0)
"""
_TELE = """
tele AS (SELECT concat('cam', CAST(user_id % 3 AS STRING)) AS stream_id, ['frame', 'metrics', 'status', 'log'][CAST(event_id % 4 + 1 AS INT)] AS kind, event_id AS seq, user_id, value FROM events),
stages AS (
  SELECT concat('cam', CAST(user_id % 3 AS STRING)) AS stream_id, event_type AS stage, value * CASE WHEN event_id % 100 = 0 THEN 100 ELSE 1 END AS duration_ms, event_type = 'error' AS failed FROM events)
"""
_CHANGES = """
raw AS (SELECT o_orderkey AS k, o_orderstatus, o_custkey % 4 <> 0 AS is_line, o_custkey % 40 AS r, o_orderstatus = 'O' AS put, substr(o_orderpriority, 1, 1) AS pr FROM orders),
pts AS (SELECT *, k * 37 % 1280 AS x1, k * 53 % 720 AS y1, (k * 37 % 1280 + 600) % 1280 AS x2, (k * 53 % 720 + 400) % 720 AS y2 FROM raw),
ch AS (
  SELECT concat('cam', CAST(k % 3 AS STRING)) AS stream_id, concat('r', CAST(r AS STRING)) AS id, k AS seq, 1704067200000 + k * 9 AS at_ms, CASE o_orderstatus WHEN 'O' THEN 'put' WHEN 'F' THEN 'patch' ELSE 'delete' END AS op,
         CASE WHEN put THEN CASE WHEN is_line THEN 'line' ELSE 'area' END END AS kind, CASE WHEN put OR pr = '2' THEN concat('n', CAST(k AS STRING)) END AS name, CASE WHEN put OR pr = '1' THEN k % 5 <> 0 END AS enabled,
         CASE WHEN put OR pr = '3' THEN CASE WHEN NOT is_line THEN format('{{"polygon":[[{},{}],[{},{}],[{},{}]]}}', x1, y1, x2, y2, x2, y1) WHEN k % 2 = 0 THEN format('{{"points":[{{"x":{},"y":{}}},{{"x":{},"y":{}}}]}}', x1, y1, x2, y2)
           ELSE format('{{"from":[{},{}],"to":[{},{}]}}', x1, y1, x2, y2) END END AS geometry,
         CASE WHEN put OR pr = '4' THEN format('{{"min_gap_ms":{},"dwell_threshold_s":{}}}', k % 4 * 500, k % 3) END AS settings FROM pts),
lf AS (SELECT *, COALESCE(last_value(CASE WHEN op <> 'patch' THEN op END IGNORE NULLS) OVER (PARTITION BY stream_id, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'put', false) AS live FROM ch),
ef AS (SELECT * FROM lf WHERE live OR op = 'put'),
ver AS (
  SELECT stream_id, id, seq, op, last_value(kind IGNORE NULLS) OVER u AS kind, last_value(name IGNORE NULLS) OVER u AS name, last_value(enabled IGNORE NULLS) OVER u AS enabled, last_value(geometry IGNORE NULLS) OVER u AS geometry,
         last_value(settings IGNORE NULLS) OVER u AS settings, last_value(CASE WHEN op = 'put' AND NOT live THEN at_ms END IGNORE NULLS) OVER u AS created_at_ms, at_ms AS updated_at_ms, at_ms AS valid_from_ms, lead(at_ms) OVER (PARTITION BY stream_id, id ORDER BY seq) AS valid_to_ms,
         last_value(CASE WHEN geometry IS NOT NULL THEN seq END IGNORE NULLS) OVER u AS g, last_value(CASE WHEN settings IS NOT NULL THEN seq END IGNORE NULLS) OVER u AS z
  FROM ef WINDOW u AS (PARTITION BY stream_id, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cur AS (SELECT * FROM ver WHERE op <> 'delete' AND valid_from_ms <= 1704067209000 AND (valid_to_ms IS NULL OR valid_to_ms > 1704067209000)),
fst AS (SELECT * FROM ch WHERE at_ms > 1704067209000 QUALIFY row_number() OVER (PARTITION BY stream_id, id ORDER BY seq) = 1)
"""
_VERSION_LINES = """
vl AS (SELECT *, CAST(g * 37 % 1280 AS DOUBLE) AS ax, CAST(g * 53 % 720 AS DOUBLE) AS ay, CAST((g * 37 % 1280 + 600) % 1280 AS DOUBLE) AS bx, CAST((g * 53 % 720 + 400) % 720 AS DOUBLE) AS b_y, CASE WHEN z % 4 = 0 THEN 1000 ELSE z % 4 * 500 END AS gap_ms
  FROM ver WHERE op <> 'delete' AND kind = 'line' AND enabled),
sides AS (
  SELECT seg.*, vl.id AS rule_id, gap_ms, valid_from_ms, (bx - ax) * (y1 - ay) - (b_y - ay) * (x1 - ax) AS s1, (bx - ax) * (y2 - ay) - (b_y - ay) * (x2 - ax) AS s2,
         (x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1) AS o1, (x2 - x1) * (b_y - y1) - (y2 - y1) * (bx - x1) AS o2, ax, ay, bx, b_y
  FROM seg JOIN vl ON seg.stream_id = vl.stream_id AND to_ts_ms >= valid_from_ms AND (valid_to_ms IS NULL OR to_ts_ms < valid_to_ms))
"""
_HEAD = """
places AS (
  SELECT row_number() OVER (ORDER BY stride, gy, gx) - 1 AS anchor, stride, gx, gy
  FROM (VALUES (8), (16), (32)) s(stride), LATERAL (SELECT unnest(range(96 // stride)) AS gy) y, LATERAL (SELECT unnest(range(160 // stride)) AS gx) x),
head AS (
  SELECT event_id, stride, gx, gy, (event_id * 7 % 100) / CAST(100 AS DOUBLE) AS rx, (event_id * 11 % 100) / CAST(100 AS DOUBLE) AS ry, (event_id * 13 % 30) / CAST(10 AS DOUBLE) AS rw,
         (event_id * 17 % 30) / CAST(10 AS DOUBLE) AS rh, LEAST((event_id * 19 % 130) / CAST(100 AS DOUBLE), 1) AS obj, LEAST((event_id * 23 % 110) / CAST(100 AS DOUBLE), 1) AS cls,
         (event_id * 7 % 40) / CAST(10 AS DOUBLE) AS l, (event_id * 11 % 40) / CAST(10 AS DOUBLE) AS t, (event_id * 13 % 40) / CAST(10 AS DOUBLE) AS r, (event_id * 17 % 40) / CAST(10 AS DOUBLE) AS b
  FROM events JOIN places ON anchor = event_id % (SELECT COUNT(*) FROM places)),
yolo AS (SELECT event_id, exp(rw) * stride AS w, exp(rh) * stride AS h, (rx + gx) * stride - exp(rw) * stride / 2 AS x, (ry + gy) * stride - exp(rh) * stride / 2 AS y, obj, cls FROM head)
"""
_T = "stream_id, profile, track_id"
_FIRST = "SELECT stream_id, profile, track_id, episode, min(frame_id) AS first_frame_id, max(frame_id) AS last_frame_id, COUNT(*) AS n_frames, arg_max_null(next_frame_id, frame_id) AS lost_frame_id, arg_max_null(next_ts_ms, frame_id) AS lost_ts_ms FROM ep GROUP BY ALL"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts)


ORACLE: dict[str, str] = {
    "samples_foot": f"{_with(_OBS)} SELECT {_T}, frame_id, ts_ms, round(foot_x, 6) AS foot_x, round(foot_y, 6) AS foot_y, score FROM f",
    "frame_sizes": f"""{_with(_OBS)}, s AS (SELECT stream_id, profile, frame_id, CASE WHEN frame_id % 3 = 0 THEN 1280 + frame_id % 2 END AS w, CASE WHEN frame_id % 3 = 0 THEN 720 END AS h FROM fr),
       c AS (SELECT stream_id, frame_id, CAST(COALESCE(last_value(w IGNORE NULLS) OVER o, 0) AS BIGINT) AS width, COALESCE(last_value(h IGNORE NULLS) OVER o, 0) AS height FROM s WINDOW o AS (PARTITION BY stream_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
       SELECT stream_id, 'ui' AS profile, track_id, frame_id, c.width, c.height FROM obs JOIN c USING (stream_id, frame_id)""",
    "frame_delta": f"{_with(_OBS)} SELECT stream_id, profile, frame_id, round(delta_s, 6) AS delta_s FROM fr",
    "track_segments": f"{_with(_OBS)} SELECT {_T}, frame_id, from_ts_ms, to_ts_ms, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(speed_px_s, 6) AS speed_px_s FROM seg",
    "directions": f"{_with(_OBS)} SELECT {_T}, frame_id, round(x2 - x1, 6) AS dx, round(y2 - y1, 6) AS dy FROM seg WHERE delta_s > 0",
    "track_dwell": f"{_with(_OBS)} SELECT {_T}, COUNT(*) AS n_obs, round(SUM(delta_s) - arg_min(delta_s, frame_id), 3) AS dwell_s FROM f GROUP BY ALL",
    "line_cross_candidates": f"{_with(_OBS, _LINES, recursive=True)} SELECT {_T}, rule_id, direction, frame_id, ts_ms, round(x, 6) AS x, round(y, 6) AS y FROM crossed",
    "line_cross_debounced": f"{_with(_OBS, _LINES, recursive=True)} SELECT {_T}, rule_id, direction, ts_ms FROM kept",
    "area_inside": f"{_with(_OBS, _AREAS)} SELECT {_T}, rule_id, COUNT(*) AS n, CAST(SUM(CAST(inside AS INT)) AS BIGINT) AS n_inside FROM ins GROUP BY ALL",
    "area_events": f"{_with(_OBS, _AREAS)} SELECT {_T}, rule_id, kind, frame_id, ts_ms, round(foot_x, 6) AS foot_x, round(foot_y, 6) AS foot_y, dwell_s, total_dwell_s FROM aev",
    "area_total_dwell": f"{_with(_OBS, _AREAS)} SELECT {_T}, rule_id, COUNT(*) AS stays, max(total_dwell_s) AS total_dwell_s FROM aev WHERE kind = 'area_exit' GROUP BY ALL",
    "episodes": f"{_with(_OBS, _AREAS)} SELECT * REPLACE (CAST(episode AS BIGINT) AS episode) FROM ({_FIRST})",
    "lost_tracks": f"{_with(_OBS, _AREAS)} SELECT {_T}, lost_frame_id AS frame_id FROM ({_FIRST}) WHERE lost_frame_id IS NOT NULL",
    "heatmap_decayed": f"{_with(_OBS, _HEAT)} SELECT stream_id, profile, cell, round(value, 6) AS value FROM heat",
    "density_by_frame": f"""{_with(_OBS)} SELECT stream_id, profile, frame_id,
       CAST(LEAST(floor(LEAST(GREATEST(foot_y, 0), height - 1e-6) / height * 36), 35) * 64 + LEAST(floor(LEAST(GREATEST(foot_x, 0), width - 1e-6) / width * 64), 63) AS BIGINT) AS cell, COUNT(*) AS value FROM f GROUP BY ALL""",
    "grid_max": f"{_with(_OBS, _HEAT)} SELECT stream_id, profile, 36 AS rows, 64 AS cols, 2304 AS n_values, round(max(value), 6) AS max_value FROM heat GROUP BY ALL",
    "active_unique_counts": f"{_with(_OBS, _SNAPS, recursive=True)} SELECT * FROM cnt",
    "snapshot_throttle": f"{_with(_OBS, _SNAPS, recursive=True)} SELECT stream_id, profile, ts_ms FROM snap",
    "recent_events_topn": f"""{_with(_OBS, _LINES, recursive=True)} SELECT stream_id, profile, string_agg(CAST(id AS STRING), ',' ORDER BY ts_ms DESC, id DESC) AS event_ids
       FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY stream_id, profile ORDER BY ts_ms DESC, id DESC) <= 25) GROUP BY ALL""",
    "route_points": f"""{_with(_OBS, _AREAS)}, pt AS (
       SELECT {_T}, episode, frame_id * 2 AS ats, COALESCE(px, foot_x) AS x, COALESCE(py, foot_y) AS y FROM ep WHERE prev_no IS NULL OR frame_no - prev_no > 1
       UNION ALL SELECT {_T}, episode, frame_id * 2 + 1, foot_x, foot_y FROM ep WHERE sqrt((foot_x - px) * (foot_x - px) + (foot_y - py) * (foot_y - py)) >= 3)
       SELECT {_T}, CAST(episode AS BIGINT) AS episode, CAST(COUNT(*) AS INT) AS n_points, round(SUM(x + y), 3) AS sum_xy
       FROM (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY {_T}, episode ORDER BY ats DESC) <= 256) GROUP BY ALL""",
    "rule_versions": f"{_with(_CHANGES)} SELECT stream_id, id, seq, op, kind, name, enabled, geometry, settings, created_at_ms, updated_at_ms, valid_from_ms, valid_to_ms FROM ver WHERE op <> 'delete'",
    "rules_list": f"{_with(_CHANGES)} SELECT id, kind, enabled, created_at_ms FROM ver WHERE op <> 'delete' AND valid_to_ms IS NULL AND stream_id = 'cam0'",
    "rules_parsed": f"""{_with(_CHANGES)} SELECT stream_id, 'ui' AS profile, concat(id, '@', CAST(seq AS STRING)) AS rule_id, CASE kind WHEN 'line' THEN 2 ELSE 3 END AS n_points,
       CAST(CASE kind WHEN 'line' THEN g * 37 % 1280 + (g * 53 % 720 + 400) % 720 ELSE g * 37 % 1280 + 2 * (g * 53 % 720) + 2 * ((g * 37 % 1280 + 600) % 1280) + (g * 53 % 720 + 400) % 720 END AS DOUBLE) AS sum_xy,
       CASE WHEN kind = 'line' THEN CASE WHEN z % 4 = 0 THEN 1000 ELSE z % 4 * 500 END END AS gap_ms, CASE WHEN kind = 'area' THEN CAST(z % 3 AS DOUBLE) END AS threshold_s FROM ver WHERE op <> 'delete'""",
    "rule_patch": f"""{_with(_CHANGES)} SELECT cur.stream_id, cur.id, cur.kind, COALESCE(p.name, cur.name) AS name, COALESCE(p.enabled, cur.enabled) AS enabled, COALESCE(p.geometry, cur.geometry) AS geometry, COALESCE(p.settings, cur.settings) AS settings,
       cur.created_at_ms, CASE WHEN p.id IS NULL THEN cur.updated_at_ms ELSE 1704067209001 END AS updated_at_ms FROM cur LEFT JOIN (SELECT * FROM fst WHERE op = 'patch') p USING (stream_id, id)""",
    "rule_delete": f"{_with(_CHANGES)} SELECT stream_id, id FROM cur WHERE NOT EXISTS (SELECT 1 FROM fst WHERE fst.op = 'delete' AND fst.stream_id = cur.stream_id AND fst.id = cur.id)",
    "rule_upsert": f"""{_with(_CHANGES)} SELECT stream_id, id, COALESCE(p.kind, c.kind) AS kind, COALESCE(p.name, c.name) AS name, COALESCE(p.enabled, c.enabled) AS enabled, COALESCE(p.geometry, c.geometry) AS geometry, COALESCE(p.settings, c.settings) AS settings,
       COALESCE(c.created_at_ms, 1704067209001) AS created_at_ms, CASE WHEN p.op IS NULL THEN c.updated_at_ms ELSE 1704067209001 END AS updated_at_ms FROM cur c FULL JOIN (SELECT * FROM fst WHERE op = 'put') p USING (stream_id, id)""",
    "line_cross_versions": f"""{_with(_OBS, _CHANGES, _VERSION_LINES, _CROSSED, recursive=True)} SELECT {_T}, rule_id, direction, frame_id, ts_ms, gap_ms, valid_from_ms
       FROM (SELECT *, to_ts_ms AS ts_ms, {_DIRECTION} AS direction FROM met) WHERE direction IS NOT NULL""",
    "events_persisted": f"""{_with(_OBS, _LINES, recursive=True)}, top AS (SELECT *, row_number() OVER (PARTITION BY stream_id, profile ORDER BY id DESC) AS place FROM ev QUALIFY place <= 50)
       SELECT stream_id, profile, array_to_string(list_concat(list(id ORDER BY id) FILTER (place <= 30), COALESCE(list(id ORDER BY id DESC) FILTER (place > 30), [])), ',') AS ids FROM top GROUP BY ALL""",
    "snapshots_shown": f"""{_with(_OBS, _LINES, _SNAPS, _HEAT, recursive=True)} SELECT last.stream_id, last.profile, false AS empty, ts_ms, active, 2304 AS n_cells,
       (SELECT round(max(round(value, 6)), 6) FROM heat h WHERE h.stream_id = last.stream_id) AS heat_max, 'area-bad,area-rect,area-tri,line-diag,line-mid,line-off' AS rules FROM last
       UNION ALL SELECT 'cam9', 'ui', true, NULL, 0, 2304, 0, ''""",
    "events_filter_topn": f"{_with(_OBS, _LINES, recursive=True)} SELECT id, track_id, direction, ts_ms FROM ev WHERE stream_id = 'cam1' AND profile = 'ui' AND rule_id = 'line-mid' ORDER BY ts_ms DESC, id DESC LIMIT 20",
    "events_count_since": f"{_with(_OBS, _LINES, recursive=True)} SELECT stream_id, profile, COUNT(*) AS n_events FROM ev WHERE ts_ms >= 1704067260000 GROUP BY ALL",
    "latest_snapshot": f"{_with(_OBS, _SNAPS, recursive=True)} SELECT stream_id, profile, frame_id, ts_ms, active, unique_tracks FROM last",
    "summary": f"""{_with(_OBS, _LINES, _SNAPS, recursive=True)} SELECT last.stream_id, last.profile, last.ts_ms, active, COUNT(ev.id) AS n_events
       FROM last LEFT JOIN ev ON ev.stream_id = last.stream_id AND ev.profile = last.profile AND ev.ts_ms >= last.ts_ms - 300000 GROUP BY ALL""",
    "snapshot_document": f"""{_with(_OBS, _LINES, _SNAPS, _HEAT, recursive=True)} SELECT last.stream_id, last.profile, frame_id, ts_ms, active, unique_tracks,
       (SELECT round(max(value), 6) FROM heat h WHERE h.stream_id = last.stream_id) AS heat_max, 2304 AS n_cells, 'area-bad,area-rect,area-tri,line-diag,line-mid,line-off' AS rules,
       CAST((SELECT LEAST(COUNT(*), 25) FROM ev WHERE ev.stream_id = last.stream_id) AS INT) AS n_events FROM last""",
    "retention_prune": f"{_with(_OBS)} SELECT stream_id, profile, COUNT(*) AS n FROM seg WHERE to_ts_ms >= 1704067200000 + 50000 GROUP BY ALL",
    "stage_metrics": f"""{_with(_TELE)} SELECT stage, stream_id, COUNT(*) AS n, CAST(SUM(CAST(failed AS INT)) AS BIGINT) AS errors, round(COUNT(*) / CAST(100 AS DOUBLE), 6) AS fps,
       round(avg(duration_ms), 3) AS avg_ms, round(min(duration_ms), 3) AS min_ms, round(max(duration_ms), 3) AS max_ms FROM stages GROUP BY GROUPING SETS ((stage), (stage, stream_id))""",
    "stage_percentiles": f"""{_with(_TELE)}, b AS (SELECT [50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 250000, 500000, 1000000, 2500000, 5000000, 10000000] AS bounds),
       h AS (SELECT stage, len(list_filter(bounds, lambda x: x < floor(duration_ms * 1000))) AS bucket, COUNT(*) AS n, max(duration_ms) AS most FROM stages, b GROUP BY ALL),
       r AS (SELECT stage, bucket, SUM(n) OVER (PARTITION BY stage ORDER BY bucket) AS upto, SUM(n) OVER (PARTITION BY stage) AS total, max(most) OVER (PARTITION BY stage) AS most FROM h),
       v AS (SELECT stage, bucket, upto, total, CASE WHEN bucket < 17 THEN bounds[CAST(bucket + 1 AS INT)] / CAST(1000 AS DOUBLE) ELSE most END AS bound FROM r, b)
       SELECT stage, round(arg_min(bound, bucket) FILTER (upto * 100 >= total * 50), 3) AS p50_ms, round(arg_min(bound, bucket) FILTER (upto * 100 >= total * 95), 3) AS p95_ms,
              round(arg_min(bound, bucket) FILTER (upto * 100 >= total * 99), 3) AS p99_ms FROM v GROUP BY ALL""",
    "stage_json": f"""{_with(_TELE)}, m AS (SELECT stage, COUNT(*) AS count, CAST(SUM(CAST(failed AS INT)) AS BIGINT) AS errors, round(avg(duration_ms), 3) AS avg_ms, round(max(duration_ms), 3) AS max_ms FROM stages GROUP BY ALL),
       b AS (SELECT [50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 250000, 500000, 1000000, 2500000, 5000000, 10000000] AS bounds),
       h AS (SELECT stage, len(list_filter(bounds, lambda x: x < floor(duration_ms * 1000))) AS bucket, COUNT(*) AS n FROM stages, b GROUP BY ALL),
       r AS (SELECT stage, bucket, SUM(n) OVER (PARTITION BY stage ORDER BY bucket) AS upto, SUM(n) OVER (PARTITION BY stage) AS total FROM h),
       p AS (SELECT stage, min(bucket) AS bucket FROM r WHERE upto * 100 >= total * 95 GROUP BY ALL)
       SELECT stage, count, errors, avg_ms, round(CASE WHEN bucket < 17 THEN bounds[CAST(bucket + 1 AS INT)] / CAST(1000 AS DOUBLE) ELSE max_ms END, 3) AS p95_ms, max_ms FROM m JOIN p USING (stage), b""",
    "queue_watermark": f"{_with(_OBS)} SELECT stream_id, frame_id, track_id, track_id * 10 AS size, 50 AS capacity, track_id * 10 * 100 // 50 AS fill_percent FROM obs WHERE track_id * 1000 // 50 >= 80",
    "metrics_history": """SELECT user_id, event_id, COUNT(*) OVER h AS n_samples, round(avg(value) OVER h, 9) AS mean_value FROM events
       WINDOW h AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""",
    "latest_by_key": f"{_with(_TELE)} SELECT user_id, kind, seq, value FROM tele QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY seq DESC) = 1",
    "metrics_coalesce": f"""{_with(_TELE)}, q AS (SELECT CAST(floor(seq / 100) AS BIGINT) AS batch, max(seq) AS seq FROM tele WHERE kind = 'metrics' GROUP BY ALL
       UNION ALL SELECT CAST(floor(seq / 100) AS BIGINT), seq FROM tele WHERE kind <> 'metrics') SELECT batch, seq FROM q QUALIFY row_number() OVER (PARTITION BY batch ORDER BY seq DESC) <= 16""",
    "telemetry_filter": f"{_with(_TELE)} SELECT stream_id, kind, COUNT(*) AS n FROM tele WHERE kind = 'status' OR kind = 'metrics' OR (kind = 'frame' AND stream_id = 'cam0') GROUP BY ALL",
    "queue_drop_oldest": f"""{_with(_TELE)} SELECT stream_id, seq, GREATEST(COUNT(*) OVER (PARTITION BY stream_id) - 512, 0) AS dropped FROM tele
       QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) <= 512""",
    "pts_pairing": f"""{_with(_OBS)}, one AS (SELECT stream_id, frame_id, CASE WHEN frame_id % 10 = 3 THEN 0 ELSE pts_ns + CASE WHEN frame_id % 7 = 0 THEN 1 ELSE 0 END END AS pts FROM fr),
       two AS (SELECT stream_id, frame_id, CASE WHEN frame_id % 10 = 4 THEN 0 ELSE pts_ns + CASE WHEN frame_id % 5 = 0 THEN 2 ELSE 0 END END AS pts FROM fr),
       bare AS (SELECT stream_id, frame_id, row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) AS n FROM one WHERE pts <= 0), bare2 AS (SELECT stream_id, frame_id, row_number() OVER (PARTITION BY stream_id ORDER BY frame_id) AS n FROM two WHERE pts <= 0)
       SELECT one.stream_id, one.frame_id, two.frame_id AS ui_frame_id, one.pts AS pts_ns FROM one JOIN two ON one.stream_id = two.stream_id AND one.pts = two.pts AND one.pts > 0
       UNION ALL SELECT bare.stream_id, bare.frame_id, bare2.frame_id, 0 FROM bare JOIN bare2 USING (stream_id, n)""",
    "frame_detection_left": f"""{_with(_OBS, _DET)} SELECT fr.stream_id, fr.frame_id, CAST(COUNT(det_idx) AS INT) AS n_boxes, COALESCE(SUM(x), 0) AS sum_x
       FROM fr LEFT JOIN (SELECT * FROM det WHERE frame_id % 3 <> 0) d USING (stream_id, frame_id) GROUP BY ALL""",
    "reorder_commit": f"""{_with(_OBS)}, a AS (SELECT stream_id, frame_id, (frame_id + CASE WHEN frame_id % 13 = 0 THEN 9 ELSE 0 END) * 1000000 + frame_id AS arrival FROM fr)
       SELECT stream_id, frame_id, frame_id < COALESCE(max(frame_id) OVER (PARTITION BY stream_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 5 AS late FROM a""",
    "det_score_split": f"{_with(_DET)} SELECT stream_id, CASE WHEN score >= 0.45 THEN 'high' ELSE 'low' END AS score_class, COUNT(*) AS n FROM det WHERE w > 1 AND h > 1 AND score >= 0.2 GROUP BY ALL",
    "det_topk": f"{_with(_DET)} SELECT stream_id, frame_id, det_idx, score FROM crowd QUALIFY row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY score DESC, det_idx) <= 3",
    "det_nms": f"""{_with(_DET)}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY score DESC, det_idx) AS n FROM crowd)
       SELECT stream_id, frame_id, det_idx, x, score FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.stream_id = a.stream_id AND b.frame_id = a.frame_id AND b.n < a.n AND {_IOU} > 0.45)""",
    "iou_pairs": f"{_with(_DET, _PAIRS)} SELECT stream_id, frame_id, track_idx, det_idx, round(iou, 6) AS iou, round(cost, 6) AS cost, round(fused_cost, 6) AS fused_cost FROM pairs",
    "assoc_greedy": f"""{_with(_DET, _PAIRS, recursive=True)}, q AS (SELECT stream_id, frame_id, track_idx, det_idx, iou, row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY iou DESC, track_idx, det_idx) AS n FROM pairs WHERE iou >= 0.3),
       fold AS (SELECT stream_id, frame_id, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS ts, CAST([] AS INT[]) AS ds, false AS took FROM q GROUP BY ALL
         UNION ALL SELECT q.stream_id, q.frame_id, q.n,
           CASE WHEN list_contains(ts, q.track_idx) OR list_contains(ds, q.det_idx) THEN ts ELSE list_append(ts, q.track_idx) END,
           CASE WHEN list_contains(ts, q.track_idx) OR list_contains(ds, q.det_idx) THEN ds ELSE list_append(ds, q.det_idx) END,
           NOT (list_contains(ts, q.track_idx) OR list_contains(ds, q.det_idx))
         FROM fold JOIN q ON q.stream_id = fold.stream_id AND q.frame_id = fold.frame_id AND q.n = fold.n + 1)
       SELECT q.stream_id, q.frame_id, track_idx, det_idx, round(iou, 6) AS iou FROM fold JOIN q ON q.stream_id = fold.stream_id AND q.frame_id = fold.frame_id AND q.n = fold.n WHERE took""",
    "track_dedup": f"""{_with(_DET)}, c AS (SELECT *, (frame_id * 7 + det_idx * 3) % 11 AS life FROM crowd),
       m AS (SELECT a.stream_id, a.frame_id, CASE WHEN a.life > b.life THEN b.det_idx ELSE a.det_idx END AS gone FROM c a JOIN c b ON a.stream_id = b.stream_id AND a.frame_id = b.frame_id AND a.det_idx < 100 AND b.det_idx >= 100 WHERE {_IOU} >= 0.5)
       SELECT stream_id, frame_id, det_idx AS track_id FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.stream_id = c.stream_id AND m.frame_id = c.frame_id AND m.gone = c.det_idx)""",
    "scene_grid_occupancy": f"{_with(_DET, _GRID)} SELECT stream_id, cell, round(used, 6) AS used, round(share, 6) AS share FROM occd",
    "scene_transition_prob": f"{_with(_DET, _GRID)} SELECT stream_id, from_cell, cell, n, round(recent, 6) AS recent, round(probability, 6) AS probability FROM trd",
    "grid_cost": f"""{_with(_DET, _GRID)} SELECT stream_id, from_cell, cell, round(LEAST(GREATEST(CAST(0.15 AS DOUBLE) * (CAST(0.65 AS DOUBLE) * LEAST(sqrt(pow(cell // 8 - from_cell // 8, 2) + pow(cell % 8 - from_cell % 8, 2)) / sqrt(74), 1)
       + CAST(0.15 AS DOUBLE) * (1 - share) + CAST(0.2 AS DOUBLE) * (1 - probability)), 0), CAST(0.3 AS DOUBLE)), 6) AS grid_cost FROM trd JOIN occd USING (stream_id, cell)""",
    "anonymize_regions": f"""{_with(_OBS)}, g AS (SELECT *, w * k AS gw, h * k AS gh FROM (SELECT *, CASE WHEN track_id % 2 = 0 THEN CAST(1.55 AS DOUBLE) ELSE CAST(1.3 AS DOUBLE) END AS k FROM obs WHERE w > 1 AND h > 1)),
       r AS (SELECT *, CAST(round(x + w / 2 - gw / 2) AS BIGINT) AS l, CAST(round(y + h / 2 - gh / 2) AS BIGINT) AS t, CAST(round(gw) AS BIGINT) AS rw0, CAST(round(gh) AS BIGINT) AS rh0 FROM g)
       SELECT * FROM (SELECT {_T}, frame_id, GREATEST(l, 0) AS rx, GREATEST(t, 0) AS ry, LEAST(l + rw0, 1280) - GREATEST(l, 0) AS rw, LEAST(t + rh0, 720) - GREATEST(t, 0) AS rh FROM r) WHERE rw >= 2 AND rh >= 2""",
    "ui_affine": f"{_with(_OBS)} SELECT {_T}, frame_id, round(x * CAST(1.5 AS DOUBLE) + 4, 6) AS x, round(y * CAST(1.5 AS DOUBLE) - 2, 6) AS y, round(w * CAST(1.5 AS DOUBLE), 6) AS w, round(h * CAST(1.5 AS DOUBLE), 6) AS h FROM obs",
    "tensor_rows": """SELECT event_id, (event_id * 7 % 100) / CAST(100 AS DOUBLE) AS rx, (event_id * 11 % 100) / CAST(100 AS DOUBLE) AS ry, (event_id * 13 % 30) / CAST(10 AS DOUBLE) AS rw, (event_id * 17 % 30) / CAST(10 AS DOUBLE) AS rh,
       (event_id * 19 % 130) / CAST(100 AS DOUBLE) AS obj, (event_id * 23 % 110) / CAST(100 AS DOUBLE) AS cls FROM events""",
    "yolox_decode": f"""{_with(_HEAD)}, u AS (SELECT event_id, obj * cls AS score, LEAST(GREATEST(x * 8, 0), 1280) AS x1, LEAST(GREATEST((y - 3) * 8, 0), 720) AS y1, LEAST(GREATEST((x + w) * 8, 0), 1280) AS x2, LEAST(GREATEST((y + h - 3) * 8, 0), 720) AS y2 FROM yolo WHERE obj * cls >= 0.3)
       SELECT event_id, round(x1, 6) AS x, round(y1, 6) AS y, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, round(score, 6) AS score FROM u WHERE x2 > x1 AND y2 > y1""",
    "yunet_decode": f"""{_with(_HEAD)},
       u AS (SELECT event_id, GREATEST(x * 8, 0) AS x1, GREATEST(y * CAST(7.5 AS DOUBLE), 0) AS y1, LEAST((x + w) * 8, 1280) AS x2, LEAST((y + h) * CAST(7.5 AS DOUBLE), 720) AS y2,
                    sqrt((event_id * 19 % 130) / CAST(100 AS DOUBLE) * ((event_id * 23 % 110) / CAST(100 AS DOUBLE))) AS score FROM yolo)
       SELECT event_id, round(x1, 6) AS x, round(y1, 6) AS y, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, round(score, 6) AS score FROM u WHERE score >= 0.35 AND x2 > x1 AND y2 > y1""",
    "scrfd_decode": f"""{_with(_HEAD)},
       a AS (SELECT event_id, (gx + CAST(0.5 AS DOUBLE)) * stride AS cx, (gy + CAST(0.5 AS DOUBLE)) * stride AS cy, stride * ((event_id * 7 % 40) / CAST(10 AS DOUBLE)) AS l, stride * ((event_id * 11 % 40) / CAST(10 AS DOUBLE)) AS t,
                    stride * ((event_id * 13 % 40) / CAST(10 AS DOUBLE)) AS r, stride * ((event_id * 17 % 40) / CAST(10 AS DOUBLE)) AS b, (event_id * 23 % 110) / CAST(100 AS DOUBLE) AS score
             FROM events JOIN places ON anchor = (event_id % (SELECT 2 * COUNT(*) FROM places)) // 2),
       u AS (SELECT event_id, score, LEAST(GREATEST((cx - l) * 8, 0), 1280) AS x1, LEAST(GREATEST((cy - t) * CAST(7.5 AS DOUBLE), 0), 720) AS y1, LEAST(GREATEST((cx + r) * 8, 0), 1280) AS x2, LEAST(GREATEST((cy + b) * CAST(7.5 AS DOUBLE), 0), 720) AS y2
             FROM a WHERE score >= 0.35)
       SELECT event_id, round(x1, 6) AS x, round(y1, 6) AS y, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, round(score, 6) AS score FROM u WHERE x2 > x1 AND y2 > y1""",
    "layer_alpha": f"""{_with(_OBS, _HEAT)}, m AS (SELECT stream_id, profile, max(value) AS most FROM heat GROUP BY ALL)
       SELECT stream_id, profile, cell, round(LEAST(0.55, 0.08 + 0.47 * value / most), 6) AS heat_alpha, round(LEAST(0.45, 0.10 + 0.35 * value / most), 6) AS density_alpha FROM heat JOIN m USING (stream_id, profile)""",
    "canvas_fit": f"{_with(_OBS)} SELECT {_T}, frame_id, round(foot_x * CAST(0.625 AS DOUBLE), 6) AS canvas_x, round(foot_y * CAST(0.625 AS DOUBLE) + 75, 6) AS canvas_y FROM f",
    "client_to_frame": """SELECT event_id, CASE WHEN x BETWEEN 0 AND 800 AND y BETWEEN 75 AND 525 THEN round(x / CAST(0.625 AS DOUBLE), 6) END AS x, CASE WHEN x BETWEEN 0 AND 800 AND y BETWEEN 75 AND 525 THEN round((y - 75) / CAST(0.625 AS DOUBLE), 6) END AS y
       FROM (SELECT event_id, event_id % 900 - 50 AS x, event_id * 7 % 700 - 50 AS y FROM events)""",
    "socket_targets": """SELECT CASE c_custkey % 3 WHEN 0 THEN concat('unix:///run/', k, '.sock') WHEN 1 THEN concat('unix:/run/', k, '.sock') ELSE concat('host', k, ':50051') END AS address,
       CASE WHEN c_custkey % 3 < 2 THEN concat('unix:/run/', k, '.sock') ELSE concat('host', k, ':50051') END AS target FROM (SELECT c_custkey, CAST(c_custkey AS STRING) AS k FROM customer)""",
    "boxes_shown": f"""{_with(_OBS)} SELECT {_T}, frame_id, round(x * CAST(0.625 AS DOUBLE), 6) AS x, round(y * CAST(0.625 AS DOUBLE) + 75, 6) AS y, round(w * CAST(0.625 AS DOUBLE), 6) AS w, round(h * CAST(0.625 AS DOUBLE), 6) AS h FROM obs""",
    "stream_urls": f"""{_with(_OBS)} SELECT stream_id, profile, concat('http://runner:8080/streams/', stream_id, '/', profile, '/snapshot.jpg') AS snapshot_url, concat('http://runner:8080/streams/', stream_id, '/', profile, '/mjpeg') AS mjpeg_url,
       concat('http://runner:8080/webrtc/', stream_id, '/', profile, '/offer') AS offer_url, concat('http://runner:8080/streams/', stream_id, '/', profile, '/meta.json') AS meta_url, stream_id <> 'cam1' AS webrtc_available
       FROM (SELECT DISTINCT stream_id, profile FROM obs)""",
    "frame_meta_json": f"{_with(_OBS)} SELECT stream_id, frame_id, CAST(max(width) AS BIGINT) AS w, COUNT(*) AS tracks FROM obs GROUP BY ALL",
    "replica_expand": """SELECT concat('s', k) AS source_id, CAST(i AS INT) AS replica, CASE WHEN c_custkey % 5 = 0 AND i = 0 THEN concat('own', k) WHEN c_custkey % 4 <= 1 THEN concat('s', k) ELSE concat('s', k, '_', CAST(i AS STRING)) END AS stream_id
       FROM (SELECT c_custkey, CAST(c_custkey AS STRING) AS k FROM customer), range(4) r(i) WHERE i < GREATEST(c_custkey % 4, 1)""",
    "thread_budget": """SELECT *, 3 * streams + detectors * detector_threads + recognizers + anonymizers + 1 AS threads, 3 * streams + detectors * detector_threads + recognizers + anonymizers + 1 <= cores AS admitted
       FROM (SELECT c_custkey, CAST(c_custkey % 5 + 1 AS INT) AS streams, CAST(c_custkey % 4 + 1 AS INT) AS detectors, CAST(c_custkey % 3 + 1 AS INT) AS detector_threads, CAST(c_custkey % 2 AS INT) AS recognizers, CAST(c_custkey % 7 + 1 AS INT) AS anonymizers, CAST(c_custkey % 61 + 4 AS INT) AS cores FROM customer)""",
    "config_problems": """WITH p AS (SELECT c_custkey, concat_ws(',', CASE WHEN k % 3 = 2 THEN 'primary' END, CASE WHEN k % 4 = 3 THEN 'fallback' END, CASE WHEN k % 5 = 4 THEN 'codec' END, CASE WHEN k % 11 = 0 THEN 'bitrate_kbps' END,
       CASE WHEN k % 13 = 0 THEN 'keyframe_interval_frames' END, CASE WHEN k % 2 = 0 AND k % 6 = 0 THEN 'max_peers_per_stream' END, CASE WHEN k % 17 = 0 THEN 'session_idle_timeout_s' END,
       CASE WHEN k * 37 % 12000 NOT BETWEEN 250 AND 10000 THEN 'ice_gathering_timeout_ms' END, CASE WHEN k % 3 = 1 AND k % 4 <> 0 THEN 'url' END, CASE WHEN k % 3 > 0 AND k % 5 = 0 THEN 'fps' END) AS problems FROM (SELECT c_custkey, c_custkey AS k FROM customer))
       SELECT *, problems = '' AS valid FROM p""",
    "streams_sorted": f"{_with(_OBS)} SELECT DISTINCT stream_id, profile FROM obs",
    "telemetry_guard": f"{_with(_TELE)} SELECT seq, stream_id, value FROM tele WHERE kind = 'frame'",
    "results_routed": f"""{_with(_OBS)} SELECT stream_id, event_id, first_frame_id FROM (SELECT concat('cam', CAST(event_id % 4 AS STRING)) AS stream_id, event_id FROM events) JOIN (SELECT stream_id, min(frame_id) AS first_frame_id FROM obs GROUP BY ALL) USING (stream_id)""",
    "stream_stage_json": f"""{_with(_TELE)}, b AS (SELECT [50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 250000, 500000, 1000000, 2500000, 5000000, 10000000] AS bounds),
       h AS (SELECT stream_id, stage, len(list_filter(bounds, lambda x: x < floor(duration_ms * 1000))) AS bucket, COUNT(*) AS n, max(duration_ms) AS most FROM stages, b GROUP BY ALL),
       r AS (SELECT stream_id, stage, bucket, SUM(n) OVER (PARTITION BY stream_id, stage ORDER BY bucket) AS upto, SUM(n) OVER (PARTITION BY stream_id, stage) AS total, max(most) OVER (PARTITION BY stream_id, stage) AS most FROM h),
       v AS (SELECT stream_id, stage, bucket, upto, total, CASE WHEN bucket < 17 THEN bounds[CAST(bucket + 1 AS INT)] / CAST(1000 AS DOUBLE) ELSE most END AS bound FROM r, b),
       p AS (SELECT stream_id, stage, round(arg_min(bound, bucket) FILTER (upto * 100 >= total * 50), 3) AS p50_ms, round(arg_min(bound, bucket) FILTER (upto * 100 >= total * 95), 3) AS p95_ms, round(arg_min(bound, bucket) FILTER (upto * 100 >= total * 99), 3) AS p99_ms FROM v GROUP BY ALL),
       m AS (SELECT stream_id, stage, COUNT(*) AS count, CAST(SUM(CAST(failed AS INT)) AS BIGINT) AS errors, round(COUNT(*) / CAST(100 AS DOUBLE), 3) AS fps, round(avg(duration_ms), 3) AS avg_ms, round(min(duration_ms), 3) AS min_ms, round(max(duration_ms), 3) AS max_ms FROM stages GROUP BY ALL)
       SELECT stream_id, stage, count, errors, fps, avg_ms, p50_ms, p95_ms, p99_ms, min_ms, max_ms FROM m JOIN p USING (stream_id, stage)""",
    "snapshots_streamed": f"{_with(_OBS, _SNAPS, recursive=True)} SELECT stream_id, profile, frame_id, ts_ms, active, unique_tracks FROM shot",
    "events_stored": f"{_with(_OBS)} SELECT {_T}, frame_id, ts_ms, row_number() OVER (ORDER BY frame_id % 3, ts_ms, stream_id, track_id) AS id FROM obs",
    "side_and_overlap": f"""{_with(_OBS)} SELECT {_T}, frame_id, round(1280 * foot_y - 720 * foot_x, 3) AS side,
       round(CASE WHEN ov > 0 THEN ov / (w * h + 120000 - ov) ELSE 0 END, 6) AS iou,
       CAST(LEAST(floor(LEAST(GREATEST(foot_y, 0), height - 1e-6) / height * 36), 35) * 64 + LEAST(floor(LEAST(GREATEST(foot_x, 0), width - 1e-6) / width * 64), 63) AS BIGINT) AS cell,
       CAST(LEAST(floor(LEAST(foot_y, 719) / 720 * 8), 7) * 12 + LEAST(floor(LEAST(foot_x, 1279) / 1280 * 12), 11) AS BIGINT) AS scene_cell
       FROM (SELECT *, GREATEST(0, LEAST(x + w, 700) - GREATEST(x, 300)) * GREATEST(0, LEAST(y + h, 500) - GREATEST(y, 200)) AS ov FROM f)""",
}

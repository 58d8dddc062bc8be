"""Track analytics over observations (stream_id, profile, frame_id, pts_ns, ts_ms, width, height, track_id, x, y, w, h, score).

Every function takes and returns DataFrames. Observations are unique per (stream, profile, frame, track), without null ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.functions import rule_json as R
from wayline.operators.sequence import SPAN, dealt, gated, with_previous, with_running, with_running_sum
from wayline.operators.stays import stay_events

P = ["stream_id", "profile"]
T = [*P, "track_id"]
ROWS, COLS, HALF_LIFE_S = 36, 64, 900.0


def frames(obs: DataFrame, span: int = SPAN) -> DataFrame:
    """The frames of each stream with their clock.

    delta_s is the time since the frame before, by media time, else by receive time, within 0 to 1 s; clock_s is its running sum,
    frame_no counts from 1; prev_frame_id, next_frame_id and next_ts_ms are of the neighbours. A stream's frames are cut into spans of
    ids: windows work within a span, and one row per span carries over what the next one needs, so a busy stream is no busy task.
    """
    seen = obs.groupBy(*P, "frame_id").agg(F.max("pts_ns").alias("pts_ns"), F.max("ts_ms").alias("ts_ms"), F.max("width").alias("width"), F.max("height").alias("height"))
    spanned = dealt(seen.withColumn("id", F.col("frame_id")), P, "frame_id", span)
    order = Window.partitionBy(*P, "_span").orderBy("frame_id")

    def delta(now: Column, before: Column) -> Column:
        pts, ts = now["pts_ns"] - before["pts_ns"], now["ts_ms"] - before["ts_ms"]
        return F.least(F.when(pts > 0, pts.cast("double") / 1e9).when(ts > 0, ts.cast("double") / 1e3).otherwise(0.0), F.lit(1.0))

    near = spanned.withColumns({"_before": F.lag("_row").over(order), "_after": F.lead("_row").over(order), "_place": F.row_number().over(order)})
    near = near.withColumn("_delta", F.when(F.col("_before").isNotNull(), delta(F.col("_row"), F.col("_before"))))
    near = near.withColumn("_run", F.coalesce(F.sum("_delta").over(order), F.lit(0.0)))
    spans = near.groupBy(*P, "_span").agg(F.min_by("_row", "frame_id").alias("_first"), F.max_by("_row", "frame_id").alias("_last"), F.max("_place").alias("_n"), F.max("_run").alias("_sum"))
    across = Window.partitionBy(*P).orderBy("_span")
    upto = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_ahead", F.lag("_last").over(across)).withColumn("_gap", F.when(F.col("_ahead").isNotNull(), delta(F.col("_first"), F.col("_ahead"))).otherwise(0.0))
    carried = carried.select(
        *P, "_span", "_ahead", "_gap", F.lead("_first").over(across).alias("_behind"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"),
        (F.coalesce(F.sum(F.col("_sum") + F.col("_gap")).over(upto), F.lit(0.0)) + F.col("_gap")).alias("_s0"),
    )
    met = near.join(carried, [*P, "_span"])
    before, after, row = F.coalesce("_before", "_ahead"), F.coalesce("_after", "_behind"), F.col("_row")
    return met.select(
        *P, "frame_id", *[row[c].alias(c) for c in ("pts_ns", "ts_ms", "width", "height")], before["id"].alias("prev_frame_id"), after["id"].alias("next_frame_id"), after["ts_ms"].alias("next_ts_ms"),
        F.coalesce("_delta", "_gap").alias("delta_s"), (F.col("_run") + F.col("_s0")).alias("clock_s"), (F.col("_place") + F.col("_n0")).alias("frame_no"),
    )


def normalised(rows: DataFrame) -> DataFrame:
    """Telemetry rows with what they lack: no stream is "", no profile "ui", no number 0; a frame without width or height takes those of
    the last frame before it that has them."""
    numbers = [c for c in ("pts_ns", "x", "y", "w", "h", "score") if c in rows.columns]
    plain = rows.withColumns({"stream_id": F.coalesce("stream_id", F.lit("")), "profile": F.coalesce("profile", F.lit("ui")), **{c: F.coalesce(c, F.lit(0)) for c in numbers}})
    sizes = plain.groupBy(*P, "frame_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    for side in ("width", "height"):
        known = F.when(F.col(side) > 0, F.struct("frame_id", side))
        sizes = with_running(sizes, P, "frame_id", known, f"_{side}", F.max, None)
    carried = sizes.select(*P, "frame_id", *[F.coalesce(F.col(f"_{side}")[side], F.lit(0)).alias(side) for side in ("width", "height")])
    return plain.drop("width", "height").join(carried, [*P, "frame_id"]).select(*rows.columns)


def with_foot(obs: DataFrame) -> DataFrame:
    x, y = G.foot(*[F.col(c) for c in "xywh"])
    return obs.withColumn("foot_x", x).withColumn("foot_y", y)


def observations(obs: DataFrame) -> DataFrame:
    """Observations with foot, the frame's delta_s, and the same track's observation before (prev_*)."""
    timed = with_foot(obs).join(frames(obs).select(*P, "frame_id", "delta_s"), [*P, "frame_id"])
    return with_previous(timed, T, "frame_id", ["foot_x", "foot_y", "ts_ms"])


def segments(obs: DataFrame) -> DataFrame:
    """The way of each track from one observation to the next, across gaps too."""
    met = observations(obs).filter(F.col("prev_ts_ms").isNotNull())
    way = G.distance(F.col("prev_foot_x"), F.col("prev_foot_y"), F.col("foot_x"), F.col("foot_y"))
    return met.select(
        *T, "frame_id", "pts_ns", F.col("prev_ts_ms").alias("from_ts_ms"), F.col("ts_ms").alias("to_ts_ms"), F.col("prev_foot_x").alias("x1"), F.col("prev_foot_y").alias("y1"),
        F.col("foot_x").alias("x2"), F.col("foot_y").alias("y2"), "delta_s", F.when(F.col("delta_s") > 0, way / F.col("delta_s")).otherwise(0.0).alias("speed_px_s"),
    )


def track_dwell(obs: DataFrame) -> DataFrame:
    """Seconds that each track was followed: the deltas of all its frames but its first. No window: a partial aggregate of sums and the first frame."""
    timed = obs.join(frames(obs).select(*P, "frame_id", "delta_s"), [*P, "frame_id"])
    sums = timed.groupBy(*T).agg(F.sum("delta_s").alias("all"), F.min_by("delta_s", "frame_id").alias("first"), F.count("*").alias("n_obs"))
    return sums.select(*T, "n_obs", F.round(F.col("all") - F.col("first"), 3).alias("dwell_s"))


def line_rules(rules: DataFrame, *more: str) -> DataFrame:
    """The enabled lines with both ends, their gap, and more columns of the rules."""
    start, end = R.line(F.col("geometry"))
    lines = rules.filter("kind = 'line' and enabled").select(*P, F.col("id").alias("rule_id"), start.alias("a"), end.alias("b"), R.gap_ms(F.col("settings")).alias("gap_ms"), *more)
    return lines.filter("a is not null and b is not null")


def area_rules(rules: DataFrame) -> DataFrame:
    return rules.filter("kind = 'area' and enabled").select(*P, F.col("id").alias("rule_id"), R.polygon(F.col("geometry")).alias("corners"), R.dwell_threshold(F.col("settings")).alias("threshold_s"))


def crossings(met: DataFrame, *more: str) -> DataFrame:
    """Of segments beside lines (a, b, rule_id, gap_ms) those that meet their line and change its side."""
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    a, b = F.col("a"), F.col("b")
    line = [a["x"], a["y"], b["x"], b["y"]]
    near = met.filter(G.boxes_near(*ends, *line)).filter(G.segments_meet(*ends, *line))
    side = lambda x, y: G.side_of_line(*line, F.col(x), F.col(y))
    found = near.withColumn("direction", G.direction(side("x1", "y1"), side("x2", "y2"))).filter("direction is not null")
    return found.select(*T, "rule_id", "direction", "frame_id", F.col("to_ts_ms").alias("ts_ms"), F.col("x2").alias("x"), F.col("y2").alias("y"), "gap_ms", *more)


def line_candidates(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Segments that meet a line of their stream and change its side."""
    return crossings(segments(obs).join(line_rules(rules), P))


def line_events(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates that stand at least the rule's gap after the last event of the same rule, track and direction."""
    keys = [*T, "rule_id", "direction"]
    return gated(line_candidates(obs, rules), keys, "ts_ms", F.col("gap_ms"))


def numbered(obs: DataFrame) -> DataFrame:
    """Observations with the frame's number in its stream, the frame after (next_*), the foot before (prev_*) and the number of the track's episode."""
    placed = with_foot(obs).join(frames(obs).select(*P, "frame_id", "frame_no", "next_frame_id", "next_ts_ms"), [*P, "frame_id"])
    met = with_previous(placed, T, "frame_id", ["foot_x", "foot_y", "frame_no"])
    opens = F.when(F.col("prev_frame_no").isNull() | (F.col("frame_no") - F.col("prev_frame_no") > 1), 1).otherwise(0)
    return with_running_sum(met.withColumn("opens", opens), T, "frame_id", F.col("opens"), "episode")


def episodes(obs: DataFrame) -> DataFrame:
    """Runs of frames in which a track is seen without a gap; lost_frame_id is the frame in which it was missing first, if there is one."""
    return numbered(obs).groupBy(*T, "episode").agg(
        F.min("frame_id").alias("first_frame_id"), F.max("frame_id").alias("last_frame_id"), F.count("*").alias("n_frames"),
        F.max_by("next_frame_id", "frame_id").alias("lost_frame_id"), F.max_by("next_ts_ms", "frame_id").alias("lost_ts_ms"),
    )


def area_inside(obs: DataFrame, rules: DataFrame) -> DataFrame:
    """Every observation against every area of its stream."""
    met = numbered(obs).join(area_rules(rules), P)
    return met.withColumn("inside", G.in_polygon(F.col("corners"), F.col("foot_x"), F.col("foot_y")))


def area_events(obs: DataFrame, rules: DataFrame, span: int = SPAN) -> DataFrame:
    """Enter, dwell-threshold and exit events of areas, with the stay's seconds and, at exits, those of all stays so far.

    A stay begins with the first observation inside in its episode, and ends with the first one outside or with the frame after the
    episode; a stay that is open at the end of the data has no exit. Whether a track was inside before is told by its foot in the frame
    before, beside which it stands already, so that only stays have a state: operators.stays.
    """
    placed = with_foot(obs).join(frames(obs, span).select(*P, "frame_id", "frame_no", "next_frame_id", "next_ts_ms"), [*P, "frame_id"])
    near = with_previous(placed, T, "frame_id", ["foot_x", "foot_y", "frame_no"], span=span, following=("frame_no",))
    met = near.join(area_rules(rules), P)
    within = lambda x, y: G.in_polygon(F.col("corners"), F.col(x), F.col(y))
    was = (F.col("prev_frame_no") == F.col("frame_no") - 1) & within("prev_foot_x", "prev_foot_y")
    last = F.coalesce(F.col("next_frame_no") > F.col("frame_no") + 1, F.lit(True))
    seen = met.withColumns({"inside": within("foot_x", "foot_y"), "was": F.coalesce(was, F.lit(False))}).withColumn("lost", F.col("inside") & last & F.col("next_frame_id").isNotNull())
    return stay_events(seen, [*T, "rule_id"], span)


def heatmap(obs: DataFrame, rows: int = ROWS, cols: int = COLS, half_life_s: float = HALF_LIFE_S) -> DataFrame:
    """Seconds spent per cell, each halved for every half-life that passed since: a sum of powers instead of a pass over frames."""
    clock = frames(obs)
    ends = clock.groupBy(*P).agg(F.max("clock_s").alias("end_s"))
    cell = G.grid_cell(F.col("foot_x"), F.col("foot_y"), F.col("width"), F.col("height"), rows, cols)
    placed = with_foot(obs).select(*P, "frame_id", cell.alias("cell")).join(clock.select(*P, "frame_id", "delta_s", "clock_s"), [*P, "frame_id"]).filter("cell is not null and delta_s > 0")
    # summed within each half-life as at its end, so that only a row per cell and half-life has to meet the stream's end
    life = F.floor(F.col("clock_s") / half_life_s) + 1
    local = placed.groupBy(*P, "cell", life.alias("_life")).agg(F.sum(F.col("delta_s") * F.pow(F.lit(0.5), life - F.col("clock_s") / half_life_s)).alias("_value"))
    decayed = F.col("_value") * F.pow(F.lit(0.5), F.col("end_s") / half_life_s - F.col("_life"))
    return local.join(ends, P).groupBy(*P, "cell").agg(F.sum(decayed).alias("value"))


def density(obs: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    cell = G.grid_cell(F.col("foot_x"), F.col("foot_y"), F.col("width"), F.col("height"), rows, cols)
    return with_foot(obs).withColumn("cell", cell).filter("cell is not null").groupBy(*P, "frame_id", "cell").agg(F.count("*").alias("value"))


def dense(layer: DataFrame, keys: list[str], rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Sparse (cell, value) rows as one array of rows x cols values per key, rounded as shown to clients, with its maximum."""
    cells = layer.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.col("value").cast("double")))).alias("_cells"), F.max("value").alias("max_value"))
    values = F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.round(F.coalesce(F.try_element_at("_cells", i.cast("bigint")), F.lit(0.0)), 6))
    return cells.select(*keys, F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), values.alias("values"), F.round("max_value", 6).alias("max_value"))


def counts(obs: DataFrame) -> DataFrame:
    """Tracks per frame, and distinct tracks of the stream up to it: a running sum of first sights."""
    active = obs.groupBy(*P, "frame_id").agg(F.count_distinct("track_id").alias("active"))
    first = obs.groupBy(*T).agg(F.min("frame_id").alias("frame_id")).groupBy(*P, "frame_id").agg(F.count("*").alias("new"))
    both = active.join(first, [*P, "frame_id"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return with_running_sum(both, P, "frame_id", F.col("new"), "unique_tracks").drop("new")


def snapshot_times(obs: DataFrame, interval_ms: int = 500) -> DataFrame:
    """The frames after which a snapshot is kept: the first, then each that comes at least interval_ms after the last kept.

    What is kept depends on what was kept before; sequence.gated runs that in spans.
    """
    return gated(obs.select(*P, "ts_ms").distinct(), P, "ts_ms", F.lit(interval_ms))


def recent_events(events: DataFrame, most: int = 25) -> DataFrame:
    """Newest events of each stream, as a list."""
    rank = F.row_number().over(Window.partitionBy(*P).orderBy(F.col("ts_ms").desc(), F.col("id").desc()))
    top = events.withColumn("place", rank).filter(F.col("place") <= most)
    return top.groupBy(*P).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda e: e["id"]).alias("event_ids"))


def route_points(obs: DataFrame, eps: float = 3.0, most: int = 256, span: int = SPAN) -> DataFrame:
    """The way of each episode: its first foot (or, after a loss, the last one before it), then each foot at least eps from the one before; the last `most`.

    Points are gathered by spans of frames, of which only the last that make up `most` points meet in an episode.
    """
    met = numbered(obs)
    far = G.distance(F.col("prev_foot_x"), F.col("prev_foot_y"), F.col("foot_x"), F.col("foot_y")) >= max(1.0, eps)
    pt = lambda x, y, at: F.struct(at.alias("at"), F.col(x).alias("x"), F.col(y).alias("y"))
    first = F.when(F.col("opens") == 1, F.when(F.col("prev_foot_x").isNull(), pt("foot_x", "foot_y", F.col("frame_id") * 2)).otherwise(pt("prev_foot_x", "prev_foot_y", F.col("frame_id") * 2)))
    then = F.when(far, pt("foot_x", "foot_y", F.col("frame_id") * 2 + 1))
    lost = F.struct("frame_id", "next_ts_ms", "next_frame_id")
    points = met.withColumn("p", F.array_compact(F.array(first, then))).groupBy(*T, "episode", F.floor(F.col("frame_id") / span).alias("_span")).agg(F.flatten(F.collect_list("p")).alias("p"), F.max(lost).alias("_lost"))
    newest = Window.partitionBy(*T, "episode").orderBy(F.col("_span").desc())
    later = F.coalesce(F.sum(F.size("p")).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = lambda p: F.when(F.size(p) > most, F.slice(p, -most, most)).otherwise(p)
    some = points.withColumn("_later", later).filter(F.col("_later") < most).withColumn("p", last(F.array_sort("p")))
    whole = some.groupBy(*T, "episode").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"), F.max("_lost").alias("_lost"))
    return whole.select(*T, "episode", F.col("_lost.next_frame_id").alias("lost_frame_id"), F.col("_lost.next_ts_ms").alias("lost_ts_ms"), F.transform(last(F.col("p")), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))

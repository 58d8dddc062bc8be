"""The catalogue of queries over the driver's tables; the SQL that each must agree with is in oracle.py under the same name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import display as D
from wayline.functions import geometry as G
from wayline.functions import settings
from wayline.operators import analytics as A
from wayline.operators import arrivals, detect, pipeline_metrics, rule_history, scene_grid, store, telemetry, tracking
from wayline.sources import fixtures as X
from wayline.sources import shared
from wayline.streaming import sink, stateful

P, T = A.P, A.T
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _to6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def samples_foot(spark, d):
    return _to6(A.with_foot(X.track_obs(spark, d)).select(*T, "frame_id", "ts_ms", "foot_x", "foot_y", "score"), "foot_x", "foot_y")


@query
def frame_sizes(spark, d):
    """Frames of which only every third tells its size, and rows without a profile."""
    told = F.col("frame_id") % 3 == 0
    bare = X.track_obs(spark, d).withColumns({"width": F.when(told, F.col("width") + F.col("frame_id") % 2), "height": F.when(told, F.col("height")).otherwise(0), "profile": F.lit(None).cast("string")})
    return A.normalised(bare).select(*T, "frame_id", "width", "height")


@query
def frame_delta(spark, d):
    return _to6(A.frames(X.track_obs(spark, d)).select(*P, "frame_id", "delta_s"), "delta_s")


@query
def track_segments(spark, d):
    return _to6(A.segments(X.track_obs(spark, d)).select(*T, "frame_id", "from_ts_ms", "to_ts_ms", "x1", "y1", "x2", "y2", "speed_px_s"), "x1", "y1", "x2", "y2", "speed_px_s")


@query
def directions(spark, d):
    way = A.segments(X.track_obs(spark, d)).filter("delta_s > 0")
    return _to6(way.select(*T, "frame_id", (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy")), "dx", "dy")


@query
def track_dwell(spark, d):
    return A.track_dwell(X.track_obs(spark, d))


@query
def line_cross_candidates(spark, d):
    return _to6(A.line_candidates(X.track_obs(spark, d), X.rules(spark)).drop("gap_ms"), "x", "y")


@query
def line_cross_debounced(spark, d):
    return A.line_events(X.track_obs(spark, d), X.rules(spark))


@query
def area_inside(spark, d):
    return A.area_inside(X.track_obs(spark, d), X.rules(spark)).groupBy(*T, "rule_id").agg(F.count("*").alias("n"), F.sum(F.col("inside").cast("long")).alias("n_inside"))


@query
def area_events(spark, d):
    return _to6(A.area_events(X.track_obs(spark, d), X.rules(spark)), "foot_x", "foot_y")


@query
def area_total_dwell(spark, d):
    exits = A.area_events(X.track_obs(spark, d), X.rules(spark)).filter("kind = 'area_exit'")
    return exits.groupBy(*T, "rule_id").agg(F.count("*").alias("stays"), F.max("total_dwell_s").alias("total_dwell_s"))


@query
def episodes(spark, d):
    return A.episodes(X.track_obs(spark, d))


@query
def lost_tracks(spark, d):
    return A.episodes(X.track_obs(spark, d)).filter("lost_frame_id is not null").select(*T, F.col("lost_frame_id").alias("frame_id"))


@query
def heatmap_decayed(spark, d):
    return _to6(A.heatmap(X.track_obs(spark, d)), "value")


@query
def density_by_frame(spark, d):
    return A.density(X.track_obs(spark, d))


@query
def grid_max(spark, d):
    return A.dense(A.heatmap(X.track_obs(spark, d)), P).select(*P, "rows", "cols", F.size("values").alias("n_values"), "max_value")


@query
def active_unique_counts(spark, d):
    return A.counts(X.track_obs(spark, d))


@query
def snapshot_throttle(spark, d):
    return A.snapshot_times(X.track_obs(spark, d))


def _events(spark, d) -> DataFrame:
    """Line events as the store keeps them, numbered within their stream."""
    found = A.line_events(X.track_obs(spark, d), X.rules(spark)).withColumn("kind", F.lit("line_cross"))
    return store.numbered_events(found, ["ts_ms", "track_id", "rule_id", "direction"])


@query
def recent_events_topn(spark, d):
    return A.recent_events(_events(spark, d)).select(*P, F.concat_ws(",", F.col("event_ids").cast("array<string>")).alias("event_ids"))


@query
def route_points(spark, d):
    points = A.route_points(X.track_obs(spark, d))
    sums = F.aggregate("points", F.lit(0.0), lambda n, p: n + p["x"] + p["y"])
    return points.select(*T, "episode", F.size("points").alias("n_points"), F.round(sums, 3).alias("sum_xy"))


@query
def routes_clustered(spark, d):
    routes = tracking.routes(A.route_points(X.track_obs(spark, d)))
    return routes.withColumn("shown", F.col("support") >= 3)


#: A time within the changes of rules.
SOME_TIME = 1_704_067_200_000 + 9_000


def _versions(spark, d) -> DataFrame:
    return rule_history.versions(X.rule_changes(spark, d))


@query
def rule_versions(spark, d):
    return _versions(spark, d).drop("profile")


@query
def rules_list(spark, d):
    return store.rules_of(rule_history.in_force(_versions(spark, d)), "cam0").select("id", "kind", "enabled", "created_at_ms")


@query
def rules_parsed(spark, d):
    """Lines and areas of all versions, as far as their geometry can be read."""
    past = _versions(spark, d).withColumns({"enabled": F.lit(True), "id": F.concat_ws("@", "id", "seq")})
    lines = A.line_rules(past).select(*P, "rule_id", F.lit(2).alias("n_points"), (F.col("a.x") + F.col("b.y")).alias("sum_xy"), "gap_ms", F.lit(None).cast("double").alias("threshold_s"))
    corners = F.aggregate("corners", F.lit(0.0), lambda n, p: n + p["x"] + p["y"])
    areas = A.area_rules(past).select(*P, "rule_id", F.size("corners").alias("n_points"), corners.alias("sum_xy"), F.lit(None).cast("bigint").alias("gap_ms"), "threshold_s")
    return lines.union(areas)


@query
def rule_patch(spark, d):
    """The rules of a time, those changed whose next change is a patch."""
    changes = X.rule_changes(spark, d)
    rules = rule_history.in_force(rule_history.versions(changes), SOME_TIME)
    return store.patched(rules, rule_history.changes_after(changes, SOME_TIME, "patch"), SOME_TIME + 1).drop("profile")


@query
def rule_delete(spark, d):
    changes = X.rule_changes(spark, d)
    rules = rule_history.in_force(rule_history.versions(changes), SOME_TIME)
    return store.deleted(rules, rule_history.changes_after(changes, SOME_TIME, "delete").select(*P, "id")).select("stream_id", "id")


@query
def rule_upsert(spark, d):
    changes = X.rule_changes(spark, d)
    rules = rule_history.in_force(rule_history.versions(changes), SOME_TIME)
    return store.upserted(rules, rule_history.changes_after(changes, SOME_TIME, "put"), SOME_TIME + 1).drop("profile")


@query
def line_cross_versions(spark, d):
    """Crossings of lines as they were when they were crossed."""
    return rule_history.line_candidates(X.track_obs(spark, d), _versions(spark, d)).select(*T, "rule_id", "direction", "frame_id", "ts_ms", "gap_ms", "valid_from_ms")


@query
def line_events_versions(spark, d):
    return rule_history.line_events(X.track_obs(spark, d), _versions(spark, d))


@query
def events_persisted(spark, d):
    """Each stream's newest fifty events, of which the newest thirty have just been stored."""
    found = _events(spark, d)
    newest = F.row_number().over(Window.partitionBy(*P).orderBy(F.col("id").desc()))
    top = found.withColumn("place", newest).filter("place <= 50")
    recent = top.groupBy(*P).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "kind"))), lambda e: F.struct(F.when(e["place"] > 30, e["id"]).alias("id"), e["kind"].alias("kind"))).alias("events"))
    merged = store.with_persisted(recent, top.filter("place <= 30").select(*P, "id", "kind"))
    return merged.select(*P, F.array_join(F.transform("events", lambda e: e["id"].cast("string")), ",").alias("ids"))


@query
def snapshots_shown(spark, d):
    """Latest snapshots of the streams that have any, and an empty one for a stream that has none."""
    last = store.latest(_snapshots(spark, d), P, "ts_ms", "frame_id").select(*P, "ts_ms", "active")
    heat = A.dense(A.heatmap(X.track_obs(spark, d)), P).select(*P, F.col("values").alias("heat"))
    streams = X.rules(spark).select(*P).union(spark.createDataFrame([("cam9", "ui")], "stream_id string, profile string")).distinct()
    shown = store.snapshots_shown(streams, last.join(heat, P), X.rules(spark))
    return shown.select(*P, "empty", "ts_ms", "active", F.size("heat").alias("n_cells"), F.round(F.array_max("heat"), 6).alias("heat_max"), F.concat_ws(",", "rules").alias("rules"))


@query
def events_filter_topn(spark, d):
    return store.newest_events(_events(spark, d), 20, stream_id="cam1", profile="ui", rule_id="line-mid").select("id", "track_id", "direction", "ts_ms")


@query
def events_count_since(spark, d):
    return store.count_since(_events(spark, d), F.lit(1_704_067_200_000 + 60_000))


def _snapshots(spark, d) -> DataFrame:
    obs = X.track_obs(spark, d)
    at = A.snapshot_times(obs)
    return A.counts(obs).join(A.frames(obs).select(*P, "frame_id", "ts_ms"), [*P, "frame_id"]).join(at, [*P, "ts_ms"])


@query
def latest_snapshot(spark, d):
    return store.latest(_snapshots(spark, d), P, "ts_ms", "frame_id").select(*P, "frame_id", "ts_ms", "active", "unique_tracks")


@query
def summary(spark, d):
    last = store.latest(_snapshots(spark, d), P, "ts_ms", "frame_id").select(*P, "ts_ms", "active")
    counted = store.count_since(_events(spark, d).join(last.select(*P, F.col("ts_ms").alias("now_ms")), P), store.since(F.col("now_ms"), 300))
    return last.join(counted, P, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


@query
def snapshot_document(spark, d):
    """The latest snapshot with the stream's rules, newest events and grids."""
    last = store.latest(_snapshots(spark, d), P, "ts_ms", "frame_id").select(*P, "frame_id", "ts_ms", "active", "unique_tracks")
    heat = A.dense(A.heatmap(X.track_obs(spark, d)), P).select(*P, F.col("values").alias("heat"), F.col("max_value").alias("heat_max"))
    rules = X.rules(spark).groupBy(*P).agg(F.array_sort(F.collect_list("id")).alias("rules"))
    met = last.join(heat, P).join(rules, P, "left").join(A.recent_events(_events(spark, d)), P, "left")
    return met.select(*P, "frame_id", "ts_ms", "active", "unique_tracks", "heat_max", F.size("heat").alias("n_cells"), F.concat_ws(",", "rules").alias("rules"), F.size("event_ids").alias("n_events"))


@query
def retention_prune(spark, d):
    kept = store.with_retention(A.segments(X.track_obs(spark, d)).withColumnRenamed("to_ts_ms", "ts_ms"), 1, 1_704_067_200_000 + 86_400_000 + 50_000)
    return kept.groupBy(*P).agg(F.count("*").alias("n"))


@query
def stage_metrics(spark, d):
    return pipeline_metrics.stage_metrics(X.stages(spark, d), 100.0)


@query
def stage_percentiles(spark, d):
    return pipeline_metrics.stage_percentiles(X.stages(spark, d))


@query
def stage_json(spark, d):
    told = pipeline_metrics.stage_json(pipeline_metrics.stage_metrics(X.stages(spark, d), 100.0), pipeline_metrics.stage_percentiles(X.stages(spark, d)))
    field = lambda name, kind: F.get_json_object("json", f"$.{name}").cast(kind).alias(name)
    return told.select("stage", field("count", "bigint"), field("errors", "bigint"), field("avg_ms", "double"), field("p95_ms", "double"), field("max_ms", "double"))


@query
def queue_watermark(spark, d):
    queues = X.track_obs(spark, d).select("stream_id", "frame_id", "track_id", (F.col("track_id") * 10).alias("size"), F.lit(50).alias("capacity"))
    return pipeline_metrics.busy_queues(queues)


@query
def metrics_history(spark, d):
    e = X.events(spark, d).select(F.col("user_id"), "event_id", "value")
    return pipeline_metrics.history(e, ["user_id"], "event_id", "value").select("user_id", "event_id", "n_samples", "mean_value")


def _telemetry(spark, d) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("frame", "metrics", "status", "log")]), (F.col("event_id") % 4 + 1).cast("int"))
    return X.events(spark, d).select(F.concat(F.lit("cam"), (F.col("user_id") % 3).cast("string")).alias("stream_id"), kinds.alias("kind"), F.col("event_id").alias("seq"), "user_id", "value")


@query
def latest_by_key(spark, d):
    return store.latest(_telemetry(spark, d).select("user_id", "kind", "seq", "value"), ["user_id", "kind"], "seq")


@query
def metrics_coalesce(spark, d):
    return telemetry.coalesced(_telemetry(spark, d).withColumn("batch", F.floor(F.col("seq") / 100)), "batch", 16)


@query
def telemetry_filter(spark, d):
    return telemetry.subscribed(_telemetry(spark, d), ["cam0"], logs=False).groupBy("stream_id", "kind").agg(F.count("*").alias("n"))


@query
def queue_drop_oldest(spark, d):
    return telemetry.kept_of_queue(_telemetry(spark, d).select("stream_id", "seq"), ["stream_id"], "seq", 512)


@query
def pts_pairing(spark, d):
    """Both sides see every frame; some without pts, and some at a moment that the other side lacks."""
    f = A.frames(X.track_obs(spark, d)).select("stream_id", "frame_id", "pts_ns")
    seen = lambda bare, odd, off: f.withColumn("pts_ns", F.when(F.col("frame_id") % 10 == bare, 0).otherwise(F.col("pts_ns") + F.when(F.col("frame_id") % odd == 0, off).otherwise(0)))
    return telemetry.paired(seen(3, 7, 1), seen(4, 5, 2))


@query
def pts_pairing_in_turn(spark, d):
    return arrivals.paired_in_turn(X.sides(spark, d))


@query
def frame_detection_left(spark, d):
    """Detections of every third frame come under an id that no frame has."""
    f = A.frames(X.track_obs(spark, d)).select("stream_id", "frame_id")
    met = telemetry.frames_with_detections(f, X.detections(spark, d).withColumn("frame_id", F.when(F.col("frame_id") % 3 == 0, -F.col("frame_id") - 1).otherwise(F.col("frame_id"))))
    return met.select("stream_id", "frame_id", F.size("boxes").alias("n_boxes"), F.coalesce(F.aggregate("boxes", F.lit(0.0), lambda n, b: n + b["x"]), F.lit(0.0)).alias("sum_x"))


@query
def frame_detection_in_turn(spark, d):
    """Frames as they come out with the boxes that reached them in time."""
    came = X.arrivals(spark, d)
    boxes = X.detections(spark, d).join(came.filter("not is_frame").select("stream_id", "frame_id", "arrival"), ["stream_id", "frame_id"])
    framed = arrivals.with_boxes(arrivals.frames_in_turn(came), boxes)
    return framed.select("stream_id", "frame_id", "arrival", "boxes_arrival", "out_at", F.size("boxes").alias("n_boxes"))


@query
def reorder_commit(spark, d):
    f = A.frames(X.track_obs(spark, d)).select("stream_id", "frame_id", (F.col("frame_id") + F.when(F.col("frame_id") % 13 == 0, 9).otherwise(0)).alias("arrival"))
    return telemetry.committed(f.withColumn("arrival", F.col("arrival") * 1_000_000 + F.col("frame_id")), span=4096 * 1_000_000).select("stream_id", "frame_id", "late")


@query
def frame_order_commit(spark, d):
    f = A.frames(X.track_obs(spark, d)).select("stream_id", "frame_id", ((F.col("frame_id") + F.when(F.col("frame_id") % 13 == 0, 9).when(F.col("frame_id") % 5 == 0, 2).otherwise(0)) * 1_000_000 + F.col("frame_id")).alias("arrival"))
    return telemetry.in_frame_order(f)


@query
def det_score_split(spark, d):
    return detect.score_class(X.detections(spark, d), 0.45, 0.2).groupBy("stream_id", "score_class").agg(F.count("*").alias("n"))


@query
def det_topk(spark, d):
    return detect.top_k(X.crowded(spark, d), 3).select("stream_id", "frame_id", "det_idx", "score")


@query
def det_nms(spark, d):
    return detect.suppressed(X.crowded(spark, d)).select("stream_id", "frame_id", "det_idx", "x", "score")


def _neighbours(spark, d) -> tuple[DataFrame, DataFrame]:
    """The boxes of a frame as tracks, and those of the next as detections, under the later frame's id."""
    now = X.crowded(spark, d)
    return now.withColumn("frame_id", F.col("frame_id") + 1), now


@query
def iou_pairs(spark, d):
    return _to6(detect.iou_pairs(*_neighbours(spark, d)), "iou", "cost", "fused_cost")


@query
def assoc_greedy(spark, d):
    return _to6(detect.greedy(detect.iou_pairs(*_neighbours(spark, d)), 0.3), "iou")


@query
def assoc_optimal(spark, d):
    return _to6(tracking.assigned(detect.iou_pairs(*_neighbours(spark, d)), 0.3), "iou")


@query
def bytetrack(spark, d):
    return tracking.track(X.detections(spark, d), "bytetrack").withColumns({c: F.round(c, 4) for c in "xywh"})


@query
def demo_track(spark, d):
    return tracking.track(X.detections(spark, d), "demo").withColumns({c: F.round(c, 4) for c in "xywh"})


@query
def track_dedup(spark, d):
    c = X.crowded(spark, d).withColumn("track_id", F.col("det_idx")).withColumn("life", (F.col("frame_id") * 7 + F.col("det_idx") * 3) % 11)
    tracked, lost = detect.duplicates(c.filter("det_idx < 100"), c.filter("det_idx >= 100"), 0.5)
    return tracked.select("stream_id", "frame_id", "track_id").union(lost.select("stream_id", "frame_id", "track_id"))


@query
def scene_grid_occupancy(spark, d):
    return _to6(scene_grid.occupancy(X.detections(spark, d)), "used", "share")


@query
def scene_transition_prob(spark, d):
    return _to6(scene_grid.transitions(X.detections(spark, d)), "recent", "probability")


@query
def grid_cost(spark, d):
    moved = scene_grid.transitions(X.detections(spark, d)).join(scene_grid.occupancy(X.detections(spark, d)), ["stream_id", "cell"])
    return _to6(scene_grid.extra_cost(moved), "grid_cost").select("stream_id", "from_cell", "cell", "grid_cost")


@query
def anonymize_regions(spark, d):
    boxes = X.track_obs(spark, d).withColumn("occluded", F.col("track_id") % 2 == 0)
    return detect.hidden_regions(boxes).select(*T, "frame_id", "rx", "ry", "rw", "rh")


@query
def ui_affine(spark, d):
    boxes = detect.scaled(X.track_obs(spark, d), F.lit(1920.0) / F.greatest(F.lit(1), F.col("width")), F.lit(1080.0) / F.greatest(F.lit(1), F.col("height")), F.lit(4.0), F.lit(-2.0))
    return _to6(boxes.select(*T, "frame_id", *"xywh"), *"xywh")


def _head(spark, d, anchors: int = 1) -> DataFrame:
    """Raw rows of a detector's head, one per event, on the anchors of a 160 x 96 input in turn."""
    n = sum((160 // s) * (96 // s) for s in detect.STRIDES) * anchors
    e = X.events(spark, d).select("event_id", (F.col("event_id") % n).cast("int").alias("anchor"))
    at = e.withColumn("p", detect.head_place(F.col("anchor"), 160, 96, anchors=anchors))
    part = lambda k, m: (F.col("event_id") * k % m).cast("double")
    return at.select(
        "event_id", F.lit(1280).alias("width"), F.lit(720).alias("height"), "p.*", (part(7, 100) / 100).alias("rx"), (part(11, 100) / 100).alias("ry"), (part(13, 30) / 10).alias("rw"), (part(17, 30) / 10).alias("rh"),
        (part(19, 130) / 100).alias("obj"), (part(23, 110) / 100).alias("cls"), (part(7, 40) / 10).alias("l"), (part(11, 40) / 10).alias("t"), (part(13, 40) / 10).alias("r"), (part(17, 40) / 10).alias("b"),
    )


def _tensor_rows(spark, d) -> DataFrame:
    # an inner explode would filter by size(rows) below it, with the data told anew for each number that rows reads of it
    told = detect.head_rows(X.tensors(spark, d)).select("event_ids", F.posexplode_outer("rows").alias("place", "v")).filter("place is not null")
    return told.select(F.get("event_ids", "place").alias("event_id"), *[F.get("v", k).cast("double").alias(n) for k, n in enumerate(("rx", "ry", "rw", "rh", "obj", "cls"))])


@query
def tensor_rows(spark, d):
    return _to6(_tensor_rows(spark, d), "rx", "ry", "rw", "rh", "obj", "cls")


@query
def yolox_decode(spark, d):
    """Boxes out of a head's flat outputs, whatever their layout."""
    raw = ("rx", "ry", "rw", "rh", "obj", "cls")
    exact = _tensor_rows(spark, d).select("event_id", *[F.round(c, 3).alias(c) for c in raw])
    boxes = detect.unboxed(detect.decode_yolox(_head(spark, d).drop(*raw).join(exact, "event_id")).filter("score >= 0.3"), 160, 96)
    return _to6(boxes.select("event_id", *"xywh", "score"), *"xywh", "score")


@query
def yunet_decode(spark, d):
    return _to6(detect.decode_yunet(_head(spark, d), 160, 96).select("event_id", *"xywh", "score"), *"xywh", "score")


@query
def scrfd_decode(spark, d):
    head = _head(spark, d, anchors=2).withColumn("score", F.col("cls"))
    return _to6(detect.decode_scrfd(head, 160, 96).select("event_id", *"xywh", "score"), *"xywh", "score")


@query
def layer_alpha(spark, d):
    heat = A.heatmap(X.track_obs(spark, d))
    most = heat.groupBy(*P).agg(F.max("value").alias("most"))
    return heat.join(most, P).select(*P, "cell", F.round(D.heat_alpha(F.col("value"), F.col("most")), 6).alias("heat_alpha"), F.round(D.density_alpha(F.col("value"), F.col("most")), 6).alias("density_alpha"))


@query
def canvas_fit(spark, d):
    scale, left, top = D.fitted(F.col("width"), F.col("height"), F.lit(800.0), F.lit(600.0))
    s = A.with_foot(X.track_obs(spark, d))
    return _to6(s.select(*T, "frame_id", (F.col("foot_x") * scale + left).alias("canvas_x"), (F.col("foot_y") * scale + top).alias("canvas_y")), "canvas_x", "canvas_y")


@query
def client_to_frame(spark, d):
    at = D.to_frame((F.col("event_id") % 900).cast("double") - 50, (F.col("event_id") * 7 % 700).cast("double") - 50, F.lit(1280.0), F.lit(720.0), F.lit(800.0), F.lit(600.0))
    return _to6(X.events(spark, d).select("event_id", at.alias("p")).select("event_id", "p.x", "p.y"), "x", "y")


@query
def socket_targets(spark, d):
    """Addresses of three forms, one for each customer."""
    name = F.col("c_custkey").cast("string")
    forms = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("unix:///run/"), name, F.lit(".sock"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("unix:/run/"), name, F.lit(".sock"))).otherwise(F.concat(F.lit("host"), name, F.lit(":50051")))
    return X.customers(spark, d).select(forms.alias("address")).select("address", D.socket_target(F.col("address")).alias("target"))


@query
def boxes_shown(spark, d):
    """Boxes as rectangles of a canvas."""
    o = X.track_obs(spark, d)
    box = D.shown(tuple(F.col(c) for c in "xywh"), F.col("width"), F.col("height"), F.lit(800.0), F.lit(600.0))
    return _to6(o.select(*T, "frame_id", box.alias("b")).select(*T, "frame_id", "b.*"), *"xywh")


@query
def stream_urls(spark, d):
    base = X.track_obs(spark, d).select(*P).distinct().withColumn("base_url", F.lit("http://runner:8080//")).withColumn("webrtc", F.when(F.col("stream_id") == "cam1", F.lit(False)))
    return D.stream_urls(base)


@query
def frame_meta_json(spark, d):
    f = X.track_obs(spark, d).groupBy(*P, "frame_id").agg(F.max("pts_ns").alias("pts_ns"), F.max("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("n_tracks"))
    meta = D.frame_meta(f)
    return f.select(F.get_json_object(meta, "$.stream_id").alias("stream_id"), F.get_json_object(meta, "$.frame_id").cast("bigint").alias("frame_id"), F.get_json_object(meta, "$.w").cast("bigint").alias("w"), F.get_json_object(meta, "$.tracks").cast("bigint").alias("tracks"))


@query
def replica_expand(spark, d):
    """A stream for each customer, with up to three copies, some of them named."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("s"), k.cast("string"))
    ids = F.when(k % 5 == 0, F.array(F.concat(F.lit("own"), k.cast("string")))).when(k % 5 == 1, F.array().cast("array<string>"))
    return D.replicas(X.customers(spark, d).select(name.alias("stream_id"), (k % 4).cast("int").alias("count"), ids.alias("ids")))


@query
def thread_budget(spark, d):
    """A set of workers for each customer."""
    k = F.col("c_custkey")
    n = lambda m, off: (k % m + off).cast("int")
    return D.threads_needed(X.customers(spark, d).select("c_custkey", n(5, 1).alias("streams"), n(4, 1).alias("detectors"), n(3, 1).alias("detector_threads"), n(2, 0).alias("recognizers"), n(7, 1).alias("anonymizers"), n(61, 4).alias("cores")))


@query
def config_problems(spark, d):
    """Settings of a stream for each customer, some of which break their rule or aren't given."""
    k = F.col("c_custkey")
    of = lambda m, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % m + 1).cast("int"))
    streams = X.customers(spark, d).select(
        "c_custkey", of(3, "webrtc", "mjpeg", "hls").alias("primary"), of(4, "mjpeg", "none", None, "webrtc").alias("fallback"), of(5, "h264", "h264", None, "h264", "av1").alias("codec"), (k % 11 * 500).cast("int").alias("bitrate_kbps"),
        (k % 13).cast("int").alias("keyframe_interval_frames"), F.when(k % 2 == 0, (k % 6).cast("int")).alias("max_peers_per_stream"), (k * 37 % 12_000).cast("int").alias("ice_gathering_timeout_ms"), (k % 17).cast("int").alias("session_idle_timeout_s"),
        of(3, "file", "rtsp", "webcam").alias("type"), F.when(k % 4 == 0, "rtsp://camera").alias("url"), (k % 3).cast("int").alias("n_profiles"), F.when(k % 5 > 0, (k % 5).cast("int")).alias("fps"),
    )
    return settings.with_problems(streams).select("c_custkey", F.array_join("problems", ",").alias("problems"), "valid")


@query
def streams_sorted(spark, d):
    return X.track_obs(spark, d).select(*P).distinct().orderBy(*P)


@query
def telemetry_guard(spark, d):
    """Events that hold a frame, of those that hold one payload of four."""
    t = _telemetry(spark, d)
    held = t.select("seq", "stream_id", *[F.when(F.col("kind") == k, F.struct("value")).alias(k) for k in ("frame", "metrics", "status", "log")])
    return telemetry.to_analyse(held).select("seq", "stream_id", F.col("frame.value").alias("value"))


@query
def results_routed(spark, d):
    """Results of four streams, of which three have a pipe."""
    e = X.events(spark, d).select(F.concat(F.lit("cam"), (F.col("event_id") % 4).cast("string")).alias("stream_id"), "event_id")
    pipes = X.track_obs(spark, d).groupBy("stream_id").agg(F.min("frame_id").alias("first_frame_id"))
    return telemetry.routed(e, pipes)


@query
def stream_stage_json(spark, d):
    """Each stream's object of stages, told apart again."""
    stages = X.stages(spark, d)
    told = pipeline_metrics.stream_json(pipeline_metrics.stage_metrics(stages, 100.0), pipeline_metrics.stage_percentiles(stages, by=("stage", "stream_id")))
    field = "struct<" + ", ".join(f"{f}: {'bigint' if f in ('count', 'errors') else 'double'}" for f in pipeline_metrics.FIELDS) + ">"
    return told.select("stream_id", F.explode(F.from_json("json", f"map<string, {field}>")).alias("stage", "m")).select("stream_id", "stage", "m.*")


@query
def snapshots_streamed(spark, d):
    """Snapshots by a stream with state over the observations, written as files of some frames a trigger first; the sink stores what is shown."""
    where = shared.folder(spark, "snapshots")
    shown = [*P, "frame_id", "ts_ms", "active", "unique_tracks"]
    stream = stateful.in_triggers(X.track_obs(spark, d), "frame_id", where)
    stateful.snapshots(stream).select(*shown).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stateful.SNAPSHOTS).parquet(f"{where}/out").select(*shown)


@query
def events_stored(spark, d):
    """Observations as events in three batches of one sink, the second of them twice: ids run on."""
    obs = X.track_obs(spark, d).select(*T, "frame_id", "ts_ms")
    stored = sink.FrameRecords(shared.folder(spark, "records"), {"events": lambda b: b, "sizes": lambda b: b.groupBy(*P).agg(F.count("*").alias("n"))}, order=("ts_ms", "stream_id", "track_id"))
    for n in (0, 1, 1, 2):
        stored.write(obs.filter(F.col("frame_id") % 3 == n), n)
    return stored.table(spark, "events")


@query
def side_and_overlap(spark, d):
    """Scalar geometry: sides of a line, overlap with a fixed box, both cell grids."""
    o = A.with_foot(X.track_obs(spark, d))
    fixed = {"x": F.lit(300.0), "y": F.lit(200.0), "w": F.lit(400.0), "h": F.lit(300.0)}
    side = G.side_of_line(F.lit(0.0), F.lit(0.0), F.lit(1280.0), F.lit(720.0), F.col("foot_x"), F.col("foot_y"))
    out = o.select(
        *T, "frame_id", F.round(side, 3).alias("side"), F.round(G.iou(G.box(), fixed), 6).alias("iou"),
        G.grid_cell(F.col("foot_x"), F.col("foot_y"), F.col("width"), F.col("height"), 36, 64).alias("cell"), G.scene_cell(F.col("foot_x"), F.col("foot_y"), F.col("width"), F.col("height"), 8, 12).alias("scene_cell"),
    )
    return out

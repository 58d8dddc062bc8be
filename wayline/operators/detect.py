"""Detections: decoding of detector heads, filters, top-k, suppression, matching, and regions to hide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import geometry as G

FRAME = ["stream_id", "frame_id"]
#: Strides of a detector head's levels; fixed values.
STRIDES = (8, 16, 32)


def eligible(detections: DataFrame, least_area: float = 0.0) -> DataFrame:
    """Boxes of more than a pixel each way and of least_area at least."""
    return detections.filter((F.col("w") > 1) & (F.col("h") > 1) & (F.col("w") * F.col("h") >= least_area))


def score_class(detections: DataFrame, high: float = 0.45, low: float = 0.2) -> DataFrame:
    """Adds score_class: high or low; boxes below low go."""
    s = F.col("score")
    return eligible(detections).withColumn("score_class", F.when(s >= high, "high").when(s >= low, "low")).filter("score_class is not null")


def top_k(detections: DataFrame, k: int) -> DataFrame:
    """The k best boxes of each frame; all for k <= 0. Ties go to the lower index."""
    if k <= 0:
        return detections
    place = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.col("score").desc(), "det_idx"))
    return detections.withColumn("_n", place).filter(F.col("_n") <= k).drop("_n")


def suppressed(detections: DataFrame, most_iou: float = 0.45) -> DataFrame:
    """Greedy non-maximum suppression: best first, a box goes if it overlaps a kept one by more than most_iou. A fold over a frame's boxes."""
    box = F.struct((-F.col("score")).alias("rank"), "det_idx", "x", "y", "w", "h", "score")
    frames = detections.groupBy(*FRAME).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    sides = lambda b: {c: b[c] for c in ("x", "y", "w", "h")}
    none = F.slice("boxes", 1, 0)
    kept = F.aggregate("boxes", none, lambda kept, b: F.when(F.exists(kept, lambda k: G.iou(sides(k), sides(b)) > most_iou), kept).otherwise(F.concat(kept, F.array(b))))
    return frames.withColumn("b", F.explode(kept)).select(*FRAME, "b.det_idx", "b.x", "b.y", "b.w", "b.h", "b.score")


def iou_pairs(left: DataFrame, right: DataFrame, least: float = 0.0) -> DataFrame:
    """Overlaps above least of boxes of equal frames: (track_idx, det_idx, iou, cost)."""
    a = left.select(*FRAME, F.col("det_idx").alias("track_idx"), *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    b = right.select(*FRAME, "det_idx", "score", *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    met = a.join(b, FRAME).withColumn("iou", G.iou(G.box("a_"), G.box("b_"))).filter(F.col("iou") > least)
    return met.select(*FRAME, "track_idx", "det_idx", "iou", (1 - F.col("iou")).alias("cost"), (1 - F.col("iou") * F.col("score")).alias("fused_cost"))


def greedy(pairs: DataFrame, least: float) -> DataFrame:
    """One-to-one matches of each frame, best overlap first. A fold over the frame's pairs with the sets of what is taken."""
    pair = F.struct((-F.col("iou")).alias("rank"), "track_idx", "det_idx", "iou")
    frames = pairs.filter(F.col("iou") >= least).groupBy(*FRAME).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    none = F.slice("pairs", 1, 0)
    taken = lambda kept, p: F.exists(kept, lambda k: (k["track_idx"] == p["track_idx"]) | (k["det_idx"] == p["det_idx"]))
    kept = F.aggregate("pairs", none, lambda kept, p: F.when(taken(kept, p), kept).otherwise(F.concat(kept, F.array(p))))
    return frames.withColumn("m", F.explode(kept)).select(*FRAME, "m.track_idx", "m.det_idx", "m.iou")


def duplicates(tracked: DataFrame, lost: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Tracked and lost tracks of a frame without those that overlap one of the other list that lives longer; a tie drops the tracked one."""
    a = tracked.select(*FRAME, F.col("track_id").alias("a_id"), F.col("life").alias("a_life"), *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    b = lost.select(*FRAME, F.col("track_id").alias("b_id"), F.col("life").alias("b_life"), *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    met = a.join(b, FRAME).filter(G.iou(G.box("a_"), G.box("b_")) >= least)
    longer = F.col("a_life") > F.col("b_life")
    less_a, less_b = met.filter(~longer).select(*FRAME, F.col("a_id").alias("track_id")), met.filter(longer).select(*FRAME, F.col("b_id").alias("track_id"))
    return tracked.join(less_a, [*FRAME, "track_id"], "left_anti"), lost.join(less_b, [*FRAME, "track_id"], "left_anti")


def scaled(boxes: DataFrame, sx: Column, sy: Column, tx: Column, ty: Column) -> DataFrame:
    """Boxes from one picture's pixels to another's."""
    return boxes.withColumns({"x": F.col("x") * sx + tx, "y": F.col("y") * sy + ty, "w": F.col("w") * sx, "h": F.col("h") * sy})


def hidden_regions(boxes: DataFrame, grow: float = 1.30, grow_occluded: float = 1.55) -> DataFrame:
    """Whole-pixel regions to hide: boxes grown about their centres, cut at the frame; boxes of a pixel and regions below two go."""
    factor = F.when(F.col("occluded"), grow_occluded).otherwise(grow)
    w, h = F.col("w") * factor, F.col("h") * factor
    left, top = G.half_away(F.col("x") + F.col("w") / 2 - w / 2), G.half_away(F.col("y") + F.col("h") / 2 - h / 2)
    grown = boxes.filter("w > 1 and h > 1").withColumns({"_l": left, "_t": top, "_w": G.half_away(w), "_h": G.half_away(h)})
    x1, y1 = F.greatest(F.col("_l"), F.lit(0)), F.greatest(F.col("_t"), F.lit(0))
    x2, y2 = F.least(F.col("_l") + F.col("_w"), F.col("width")), F.least(F.col("_t") + F.col("_h"), F.col("height"))
    cut = grown.withColumns({"rx": x1.cast("bigint"), "ry": y1.cast("bigint"), "rw": (x2 - x1).cast("bigint"), "rh": (y2 - y1).cast("bigint")})
    return cut.filter("rw >= 2 and rh >= 2").drop("_l", "_t", "_w", "_h")


def letterbox(width: Column, height: Column, in_w: int, in_h: int) -> tuple[Column, Column, Column]:
    """Scale and whole-pixel margins that fit a picture into a detector's input."""
    scale = F.least(F.lit(float(in_w)) / width, F.lit(float(in_h)) / height)
    pad = lambda size, room: F.floor((room - F.floor(size * scale)) / 2)
    return scale, pad(width, in_w), pad(height, in_h)


def head_place(anchor: Column, in_w: int, in_h: int, strides: tuple[int, ...] = STRIDES, anchors: int = 1) -> Column:
    """Where an anchor of a head stands: (stride, gx, gy), told from its number, which counts level by level, row by row, a place as often as it has anchors; null past the last."""
    place, begin = F.lit(None), 0
    for s in strides:
        cols, rows = in_w // s, in_h // s
        at = F.floor((anchor - begin) / anchors)
        of_level = F.struct(F.lit(s).alias("stride"), (at % cols).cast("int").alias("gx"), F.floor(at / cols).cast("int").alias("gy"))
        place = F.when(anchor.between(begin, begin + cols * rows * anchors - 1), of_level).otherwise(place)
        begin += cols * rows * anchors
    return place


def head_rows(tensors: DataFrame, values: int = 6) -> DataFrame:
    """Adds rows, an array of arrays of `values` floats, to flat outputs of a head (data array<float>, dims, w, h, c int), told apart by their shape.

    Rows of a matrix that is `values` wide; columns of one that is `values` high; the rows of all channels, one after the other, where each is `values` wide
    (channel_step: floats from one channel to the next, as channels may be padded; null: w x h); of any other shape, runs of `values`
    floats, what is left over dropped. Outputs of fewer than `values` floats have no rows.
    """
    data, dims, w, h, c = (F.col(n) for n in ("data", "dims", "w", "h", "c"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    run = lambda at: F.slice(data, at + 1, values)
    step = F.coalesce(F.col("channel_step"), w * h) if "channel_step" in tensors.columns else w * h
    across = F.transform(upto(w), lambda x: F.transform(F.sequence(F.lit(0), F.lit(values - 1)), lambda k: F.get(data, k * w + x)))
    channels = F.flatten(F.transform(upto(c), lambda q: F.transform(upto(h), lambda y: run(q * step + y * values))))
    of_shape = F.when((dims == 2) & (w == values), F.transform(upto(h), lambda y: run(y * values))).when((dims == 2) & (h == values), across).when((dims == 3) & (w == values), channels)
    flat = F.transform(upto(F.floor(F.size(data) / values).cast("int")), lambda i: run(i * values))
    none = F.array().cast("array<array<float>>")
    return tensors.withColumn("rows", F.when(F.coalesce(F.size(data), F.lit(0)) < values, none).otherwise(F.coalesce(of_shape, flat)))


def decode_yolox(rows: DataFrame) -> DataFrame:
    """(stride, gx, gy, rx, ry, rw, rh, obj, cls) to a centred box in input pixels with the product of both scores; rows past the last level, without a stride, hold such a box already."""
    one = lambda v: F.least(F.greatest(F.col(v), F.lit(0.0)), F.lit(1.0))
    s, bare = F.col("stride"), F.col("stride").isNull()
    of_place = lambda raw, decoded: F.when(bare, F.col(raw)).otherwise(decoded)
    w, h = of_place("rw", F.exp("rw") * s), of_place("rh", F.exp("rh") * s)
    cx, cy = of_place("rx", (F.col("rx") + F.col("gx")) * s), of_place("ry", (F.col("ry") + F.col("gy")) * s)
    return rows.withColumns({"w": w, "h": h, "x": cx - w / 2, "y": cy - h / 2, "score": one("obj") * one("cls")})


def in_frame(boxes: DataFrame, in_w: int, in_h: int) -> DataFrame:
    """Boxes in a detector's input, which shows the frame stretched to its size, in frame pixels and cut at the frame; those without area go."""
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    sx, sy = F.col("width") / F.lit(float(in_w)), F.col("height") / F.lit(float(in_h))
    x1, y1 = clip(F.col("x") * sx, F.col("width")), clip(F.col("y") * sy, F.col("height"))
    x2, y2 = clip((F.col("x") + F.col("w")) * sx, F.col("width")), clip((F.col("y") + F.col("h")) * sy, F.col("height"))
    return boxes.withColumns({"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1}).filter("w > 0 and h > 0")


def decode_yunet(rows: DataFrame, in_w: int, in_h: int, least_score: float = 0.35) -> DataFrame:
    """Places as in decode_yolox, scored by the geometric mean of both scores as they are; boxes under least_score go, the rest stand in the frame (width, height)."""
    scored = decode_yolox(rows).withColumn("score", F.sqrt(F.col("obj") * F.col("cls")))
    return in_frame(scored.filter(F.col("score") >= least_score), in_w, in_h)


def decode_scrfd(rows: DataFrame, in_w: int, in_h: int, least_score: float = 0.35) -> DataFrame:
    """(stride, gx, gy, l, t, r, b, score): distances, in strides, from the centre of a place to a box's edges. Boxes under least_score go, the rest stand in the frame (width, height)."""
    s = F.col("stride")
    x, y = (F.col("gx") + 0.5 - F.col("l")) * s, (F.col("gy") + 0.5 - F.col("t")) * s
    boxes = rows.withColumns({"x": x, "y": y, "w": (F.col("l") + F.col("r")) * s, "h": (F.col("t") + F.col("b")) * s})
    return in_frame(boxes.filter(F.col("score") >= least_score), in_w, in_h)


def unboxed(boxes: DataFrame, in_w: int, in_h: int) -> DataFrame:
    """Boxes in a detector's letterboxed input back to frame pixels, cut at the frame; those without area go."""
    scale, px, py = letterbox(F.col("width"), F.col("height"), in_w, in_h)
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    x1, y1 = clip((F.col("x") - px) / scale, F.col("width")), clip((F.col("y") - py) / scale, F.col("height"))
    x2, y2 = clip((F.col("x") + F.col("w") - px) / scale, F.col("width")), clip((F.col("y") + F.col("h") - py) / scale, F.col("height"))
    return boxes.withColumns({"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1}).filter("w > 0 and h > 0")

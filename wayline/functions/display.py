"""What clients see: addresses, display geometry, layer strength, frame metadata, replicas, admission of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_urls(streams: DataFrame) -> DataFrame:
    """Four addresses per stream under a base that may end in slashes."""
    base = F.rtrim(F.col("base_url"), F.lit("/"))
    tail = F.concat(F.col("stream_id"), F.lit("/"), F.col("profile"))
    return streams.select(
        "stream_id", "profile", F.concat(base, F.lit("/streams/"), tail, F.lit("/snapshot.jpg")).alias("snapshot_url"), F.concat(base, F.lit("/streams/"), tail, F.lit("/mjpeg")).alias("mjpeg_url"),
        F.concat(base, F.lit("/webrtc/"), tail, F.lit("/offer")).alias("offer_url"), F.concat(base, F.lit("/streams/"), tail, F.lit("/meta.json")).alias("meta_url"), F.coalesce("webrtc", F.lit(True)).alias("webrtc_available"),
    )


def fitted(frame_w: Column, frame_h: Column, rect_w: Column, rect_h: Column) -> tuple[Column, Column, Column]:
    """Scale and margins that show a frame whole and centred in a rectangle."""
    scale = F.least(rect_w / frame_w, rect_h / frame_h)
    return scale, (rect_w - frame_w * scale) / 2, (rect_h - frame_h * scale) / 2


def shown(box: tuple[Column, Column, Column, Column], frame_w: Column, frame_h: Column, rect_w: Column, rect_h: Column) -> Column:
    """A box of the frame (x, y, w, h) as the rectangle in which it is shown; null for a frame without size."""
    scale, left, top = fitted(frame_w, frame_h, rect_w, rect_h)
    x, y, w, h = box
    return F.when((frame_w > 0) & (frame_h > 0), F.struct((x * scale + left).alias("x"), (y * scale + top).alias("y"), (w * scale).alias("w"), (h * scale).alias("h")))


def to_frame(x: Column, y: Column, frame_w: Column, frame_h: Column, rect_w: Column, rect_h: Column) -> Column:
    """The frame's point that is shown at a point of the rectangle; null beside the frame."""
    scale, left, top = fitted(frame_w, frame_h, rect_w, rect_h)
    fx, fy = x - left, y - top
    return F.when((fx >= 0) & (fy >= 0) & (fx <= frame_w * scale) & (fy <= frame_h * scale), F.struct((fx / scale).alias("x"), (fy / scale).alias("y")))


def socket_target(address: Column) -> Column:
    """An address as a client of local sockets wants it: without the slashes after its scheme."""
    return F.regexp_replace(address, "^unix://", "unix:")


def heat_alpha(value: Column, most: Column) -> Column:
    return F.when(value > 0, F.least(F.lit(0.55), 0.08 + 0.47 * value / most))


def density_alpha(value: Column, most: Column) -> Column:
    return F.when(value > 0, F.least(F.lit(0.45), 0.10 + 0.35 * value / most))


def frame_meta(frames: DataFrame) -> Column:
    return F.to_json(F.struct("stream_id", "profile", "frame_id", "pts_ns", F.col("width").alias("w"), F.col("height").alias("h"), F.col("n_tracks").alias("tracks")))


def replicas(streams: DataFrame) -> DataFrame:
    """count copies of each stream (stream_id, count, ids): named by ids where given, else numbered; a single copy keeps its name."""
    i = F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("count"), F.lit(1)) - 1)).alias("replica", "_i")
    numbered = F.when(F.col("count") <= 1, F.col("stream_id")).otherwise(F.concat("stream_id", F.lit("_"), F.col("replica").cast("string")))
    return streams.select("*", i).select(F.col("stream_id").alias("source_id"), "replica", F.coalesce(F.get("ids", "replica"), numbered).alias("stream_id"))


def threads_needed(streams: DataFrame) -> DataFrame:
    """Threads of a set of streams and workers, and whether the cores allow them."""
    n = 3 * F.col("streams") + F.col("detectors") * F.col("detector_threads") + F.col("recognizers") + F.col("anonymizers") + 1
    return streams.withColumn("threads", n).withColumn("admitted", n <= F.col("cores"))

"""Track observations, detections, rules and telemetry derived from the driver's `events` table, by integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STREAMS, LANES, WIDTH, HEIGHT = 3, 5, 1280, 720


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def track_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per (stream, frame, track); of several the last stays, which a partial aggregate finds before the shuffle."""
    e = events(spark, sf_dir)
    frame = F.floor(F.col("event_id") / 20)
    seen = e.select(
        F.concat(F.lit("cam"), (F.col("user_id") % STREAMS).cast("string")).alias("stream_id"),
        frame.alias("frame_id"),
        (F.floor((F.col("user_id") % 15) / 3) + 1).alias("track_id"),
        "event_id", "user_id",
    )
    last = seen.groupBy("stream_id", "frame_id", "track_id").agg(F.max_by("user_id", "event_id").alias("user_id"), F.max("event_id").alias("event_id"))
    pts = F.col("frame_id") * 200_000_000 + F.floor(F.col("event_id") / 1000) * 3_000_000_000
    ev = F.col("event_id")
    return last.withColumn("pts_ns", pts).select(
        "stream_id", F.when(F.col("event_id").isNotNull(), "ui").alias("profile"), "frame_id", "pts_ns", (F.lit(1_704_067_200_000) + F.floor(F.col("pts_ns") / 1_000_000)).alias("ts_ms"),
        F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "track_id",
        ((ev * 7919) % 1240).cast("double").alias("x"), ((ev * 104729) % 640).cast("double").alias("y"),
        (20 + F.col("user_id") % 60).cast("double").alias("w"), (40 + ev % 120).cast("double").alias("h"), ((30 + ev % 70).cast("double") / 100).alias("score"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth lanes of boxes: about one in eleven missing, one in nine of low score."""
    frames = events(spark, sf_dir).select(F.floor(F.col("event_id") / 20).alias("frame_id")).distinct()
    places = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(STREAMS - 1)), lambda s: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.struct(s.alias("sid"), k.alias("lane"))))))
    d = frames.withColumn("p", places).select("frame_id", "p.sid", "p.lane").filter((F.col("frame_id") * 5 + F.col("lane") * 3 + F.col("sid")) % 11 != 0)
    return d.select(
        F.concat(F.lit("cam"), F.col("sid").cast("string")).alias("stream_id"), "frame_id", F.col("lane").alias("det_idx"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
        ((F.col("frame_id") * 6 + F.col("lane") * 220 + F.col("sid") * 40) % 1200).cast("double").alias("x"), (F.col("lane") * 110).cast("double").alias("y"),
        F.lit(80.0).alias("w"), F.lit(180.0).alias("h"), F.when((F.col("frame_id") + F.col("lane")) % 9 == 0, 0.25).otherwise(0.9).alias("score"),
    )


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections with a shifted, weaker copy of every fourth."""
    d = detections(spark, sf_dir)
    copy = d.filter((F.col("frame_id") + F.col("det_idx")) % 4 == 0).withColumn("x", F.col("x") + 10).withColumn("score", F.col("score") - 0.05).withColumn("det_idx", F.col("det_idx") + 100)
    return d.unionByName(copy)


_RULES = [
    ("line-mid", "line", True, '{"points":[{"x":640,"y":0},{"x":640,"y":720}]}', '{"min_gap_ms":1000}', 1),
    ("line-diag", "line", True, '{"from":[0,0],"to":[1280,720]}', "{}", 2),
    ("line-off", "line", False, '{"points":[{"x":320,"y":0},{"x":320,"y":720}]}', "{}", 3),
    ("area-rect", "area", True, '{"points":[{"x":320,"y":180},{"x":960,"y":180},{"x":960,"y":540},{"x":320,"y":540}]}', '{"dwell_threshold_s":0.4}', 4),
    ("area-tri", "area", True, '{"polygon":[[100,100],[1200,100],[640,700]]}', "{}", 5),
    ("area-bad", "area", True, '{"points":[{"x":0,"y":0},{"x":10,"y":10}]}', "{}", 6),
]


def rules(spark: SparkSession) -> DataFrame:
    """Six rules for each of the three streams, as the store keeps them: geometry and settings are JSON."""
    rows = [(name, f"cam{s}", "ui", kind, name, on, geometry, settings, 1_704_067_200_000 + at, 1_704_067_200_000 + at) for s in range(STREAMS) for name, kind, on, geometry, settings, at in _RULES]
    return spark.createDataFrame(rows, "id string, stream_id string, profile string, kind string, name string, enabled boolean, geometry string, settings string, created_at_ms bigint, updated_at_ms bigint")


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of forty rules a stream, one for each of the driver's orders: put, patch or delete by the order's status; what a patch sets by its priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, put = F.col("o_orderkey"), F.col("o_orderstatus") == "O"
    sets = lambda priority, value: F.when(put | (F.col("o_orderpriority").substr(1, 1) == priority), value)
    x, y, text = k * 37 % 1280, k * 53 % 720, lambda c: c.cast("string")
    ends = [text(x), text(y), text((x + 600) % 1280), text((y + 400) % 720)]
    line = F.when(k % 2 == 0, F.format_string('{"points":[{"x":%s,"y":%s},{"x":%s,"y":%s}]}', *ends)).otherwise(F.format_string('{"from":[%s,%s],"to":[%s,%s]}', *ends))
    area = F.format_string('{"polygon":[[%s,%s],[%s,%s],[%s,%s]]}', *ends, ends[2], ends[1])
    is_line = F.col("o_custkey") % 4 != 0
    return o.select(
        F.concat(F.lit("cam"), text(k % STREAMS)).alias("stream_id"), F.lit("ui").alias("profile"), F.format_string("r%s", text(F.col("o_custkey") % 40)).alias("id"), k.alias("seq"), (F.lit(1_704_067_200_000) + k * 9).alias("at_ms"),
        F.when(put, "put").when(F.col("o_orderstatus") == "F", "patch").otherwise("delete").alias("op"), F.when(put, F.when(is_line, "line").otherwise("area")).alias("kind"), sets("2", F.format_string("n%s", text(k))).alias("name"),
        sets("1", k % 5 != 0).alias("enabled"), sets("3", F.when(is_line, line).otherwise(area)).alias("geometry"), sets("4", F.format_string('{"min_gap_ms":%s,"dwell_threshold_s":%s}', text(k % 4 * 500), text(k % 3))).alias("settings"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and their detections as they reach a stream: some frames late within their turn, some detections twelve frames late, some under an id that no frame has."""
    d = detections(spark, sf_dir)
    late = lambda by: F.col("frame_id") * 1000 + by
    f = d.select("stream_id", "frame_id").distinct()
    frames = f.select("stream_id", F.lit(True).alias("is_frame"), "frame_id", late(F.when(F.col("frame_id") % 5 == 1, 700).otherwise(0)).alias("arrival"))
    boxed = f.select("stream_id", F.lit(False).alias("is_frame"), F.when(F.col("frame_id") % 11 == 7, -F.col("frame_id") - 1).otherwise(F.col("frame_id")).alias("frame_id"), late(F.when(F.col("frame_id") % 7 == 2, 12_351).otherwise(1301)).alias("arrival"))
    return frames.union(boxed)


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of both sides of a stream: some frames of one side come late, without pts, or at a moment that the other lacks."""
    f = events(spark, sf_dir).select(F.explode(F.array(*[F.lit(f"cam{s}") for s in range(STREAMS)])).alias("stream_id"), F.floor(F.col("event_id") / 20).alias("frame_id")).distinct()

    def side(n: int, bare: int, odd: int, late: int) -> DataFrame:
        k = F.col("frame_id")
        pts = F.when(k % 10 == bare, 0).otherwise((k + 1) * 1000 + F.when(k % odd == 0, n + 1).otherwise(0))
        return f.select("stream_id", F.lit(n).cast("bigint").alias("side"), pts.cast("bigint").alias("pts_ns"), "frame_id", (k * 100 + n + F.when(k % 17 == 3, late).otherwise(0)).alias("arrival"))

    return side(0, 3, 7, 330).union(side(1, 4, 5, 1010))


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat outputs of a detector's head, one for each twenty events in turn, in four layouts: (tensor, data, dims, w, h, c, channel_step, event_ids)."""
    e = events(spark, sf_dir)
    part = lambda k, m, by: ((F.col("event_id") * k % m).cast("double") / by).cast("float")
    row = F.struct("event_id", F.array(part(7, 100, 100), part(11, 100, 100), part(13, 30, 10), part(17, 30, 10), part(19, 130, 100), part(23, 110, 100)).alias("v"))
    rows = e.groupBy(F.floor(F.col("event_id") / 20).alias("tensor")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    n, v, layout = F.size("rows"), F.col("rows")["v"], F.col("tensor") % 4
    columns = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.transform(v, lambda x: F.get(x, k))))
    # two channels of half the rows each, padded by four floats
    half = F.ceil(n / 2).cast("int")
    padding = lambda m: F.array_repeat(F.lit(0.0).cast("float"), m)
    channels = F.concat(F.flatten(F.slice(v, F.lit(1), half)), padding(4), F.flatten(F.slice(v, half + 1, half)), padding(4 + half * 12 - n * 6))
    data = F.when(layout == 1, columns).when(layout == 2, channels).otherwise(F.flatten(v))
    pick = lambda *of: F.element_at(F.array(*[x if not isinstance(x, int) else F.lit(x) for x in of]), (layout + 1).cast("int")).cast("int")
    return rows.select("tensor", data.alias("data"), pick(2, 2, 3, 1).alias("dims"), pick(F.lit(6), n, F.lit(6), n * 6).alias("w"), pick(n, F.lit(6), half, F.lit(1)).alias("h"), pick(1, 1, 2, 1).alias("c"), F.when(layout == 2, half * 6 + 4).alias("channel_step"), F.col("rows")["event_id"].alias("event_ids"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of pipeline stages in ms; every hundredth is scaled up past the last bucket."""
    slow = F.when(F.col("event_id") % 100 == 0, 100.0).otherwise(1.0)
    return events(spark, sf_dir).select(
        F.concat(F.lit("cam"), (F.col("user_id") % STREAMS).cast("string")).alias("stream_id"), F.col("event_type").alias("stage"), (F.col("value") * slow).alias("duration_ms"), (F.col("event_type") == "error").alias("failed")
    )

"""Metrics of pipeline stages from their durations: counts, rates and percentiles of a fixed histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the histogram's buckets in microseconds; fixed values.
BOUNDS_US = (50, 100, 250, 500, 1000, 2500, 5000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000)


def stage_metrics(stages: DataFrame, uptime_s: float) -> DataFrame:
    """Per stage, and per stage and stream: count, errors, rate over the uptime, mean, least and most. One pass over both groupings."""
    return stages.groupingSets([["stage"], ["stage", "stream_id"]], "stage", "stream_id").agg(
        F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("errors"), F.round(F.count("*") / uptime_s, 6).alias("fps"),
        F.round(F.avg("duration_ms"), 3).alias("avg_ms"), F.round(F.min("duration_ms"), 3).alias("min_ms"), F.round(F.max("duration_ms"), 3).alias("max_ms"),
    )


def stage_percentiles(stages: DataFrame, percents: tuple[int, ...] = (50, 95, 99), by: tuple[str, ...] = ("stage",)) -> DataFrame:
    """The bound of the first bucket that brings the count to a percentile's share; past the last bucket, the most that was seen."""
    us = F.floor(F.col("duration_ms") * 1000)
    bounds = F.array(*[F.lit(b).cast("bigint") for b in BOUNDS_US])
    bucket = F.size(F.filter(bounds, lambda b: b < us))
    hist = stages.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("duration_ms").alias("most"))
    whole = Window.partitionBy(*by)
    run = hist.withColumns({"upto": F.sum("n").over(whole.orderBy("bucket")), "total": F.sum("n").over(whole), "most": F.max("most").over(whole)})
    bound = F.when(F.col("bucket") < len(BOUNDS_US), F.get(bounds, "bucket").cast("double") / 1000).otherwise(F.col("most"))
    reached = lambda p: F.round(F.min_by(bound, F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket"))), 3)
    return run.groupBy(*by).agg(*[reached(p).alias(f"p{p}_ms") for p in percents])


#: The stages in the order in which they are told; fixed values of the format are the fields and their order.
FIELDS = ("count", "errors", "fps", "avg_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms")


def _object() -> Column:
    return F.to_json(F.struct(*[F.round(c, 3).alias(c) if c not in ("count", "errors") else F.col(c) for c in FIELDS]))


def stage_json(metrics: DataFrame, percentiles: DataFrame) -> DataFrame:
    """(stage, json) of each stage over all streams: its metrics and percentiles as one object, numbers to three places."""
    met = metrics.filter("stream_id is null").drop("stream_id").withColumnRenamed("n", "count").join(percentiles, "stage")
    return met.select("stage", _object().alias("json"))


def stream_json(metrics: DataFrame, percentiles: DataFrame) -> DataFrame:
    """(stream_id, json): an object of each stream with an object of each of its stages, in the order of their names; percentiles by stage and stream."""
    met = metrics.filter("stream_id is not null").withColumnRenamed("n", "count").join(percentiles, ["stage", "stream_id"])
    told = met.select("stream_id", F.struct("stage", _object().alias("json")).alias("s"))
    field = lambda s: F.concat(F.to_json(F.array(s["stage"])).substr(F.lit(2), F.length(F.to_json(F.array(s["stage"]))) - 2), F.lit(":"), s["json"])
    return told.groupBy("stream_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), field), ","), F.lit("}")).alias("json"))


def busy_queues(queues: DataFrame, percent: int = 80) -> DataFrame:
    """Queues filled to percent of their capacity or more, by whole percents; those without capacity are left out."""
    fill = F.floor(F.col("size") * 100 / F.col("capacity"))
    return queues.filter("capacity > 0").withColumn("fill_percent", fill).filter(F.col("fill_percent") >= percent)


def history(metrics: DataFrame, keys: list[str], order: str, value: str, last: int = 120) -> DataFrame:
    """Mean and count of the last samples of each key."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(last - 1), 0)
    return metrics.withColumn("n_samples", F.count("*").over(frame)).withColumn("mean_value", F.round(F.avg(value).over(frame), 9))

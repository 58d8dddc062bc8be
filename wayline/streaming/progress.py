"""What a running query tells of itself as rows: how much it reads, what waits before it, what its state holds."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, batch bigint, at string, source int, n_rows bigint, rows_per_s double, waiting bigint, state_rows bigint, dropped_late bigint"


class Progress(StreamingQueryListener):
    """Keeps the last `most` reports of each query: one row for each of its sources. Add it with spark.streams.addListener.

    waiting: by query, what is known to wait once a source has read up to an offset (telemetry_source.waiting gives such a function); a source that
    reports how far it is behind needs none.
    """

    def __init__(self, most: int = 1000, waiting: dict[str, Callable[[object], int]] | None = None):
        self.most, self.waiting, self.rows = most, waiting or {}, {}

    def _waits(self, name: str, source: dict) -> int:
        if name in self.waiting:
            return self.waiting[name](source.get("endOffset"))
        told = source.get("metrics") or {}
        return int(float(told.get("maxOffsetsBehindLatest", 0)))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = json.loads(event.progress.json)
        states = told.get("stateOperators", [])
        held, late = (sum(s.get(k, 0) for s in states) for k in ("numRowsTotal", "numRowsDroppedByWatermark"))
        name = told.get("name") or told["id"]
        for k, source in enumerate(told.get("sources", [])):
            self.rows.setdefault(name, deque(maxlen=self.most)).append(
                (name, told["batchId"], told["timestamp"], k, source["numInputRows"], float(source.get("processedRowsPerSecond") or 0.0), self._waits(name, source), held, late)
            )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r for rows in list(self.rows.values()) for r in list(rows)], PROGRESS)


def queue_figures(progress: DataFrame, capacity: int) -> DataFrame:
    """A query's queue as its last report shows it: what waits (size), what may wait (capacity), what came too late (dropped), and whether it fills up."""
    last = progress.groupBy("query").agg(F.max_by(F.struct("waiting", "dropped_late", "batch"), F.struct("batch", "at")).alias("l"))
    size = F.col("l.waiting")
    return last.select("query", F.col("l.batch").alias("batch"), size.alias("size"), F.lit(capacity).cast("bigint").alias("capacity"), F.col("l.dropped_late").alias("dropped"), F.lit("delay").alias("drop_policy"), (100 * size >= 80 * capacity).alias("high"))


def with_figures(summary: DataFrame, queue: DataFrame, retention: dict[str, float | None]) -> DataFrame:
    """A summary of streams with the queue's figures (one row: those of the query that feeds it) and the retention's settings."""
    settings = {name: F.lit(days).cast("double").alias(name) for name, days in retention.items()}
    figures = queue.limit(1).select(F.struct("size", "capacity", "dropped", "drop_policy", "high").alias("queue")).first()
    told = F.lit(None).cast("struct<size: bigint, capacity: bigint, dropped: bigint, drop_policy: string, high: boolean>")
    if figures is not None:
        told = F.struct(*[F.lit(v).alias(k) for k, v in figures.queue.asDict().items()])
    return summary.withColumns({"queue": told, "retention": F.struct(*settings.values())})

"""Stored tables in partitions of days, and what is older than their retention dropped from them.

A day that lies wholly before the cut is dropped as a partition, without reading a row; only the day of the cut is read and written anew. All
others keep their files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: By stored table, the setting of its retention and the column of its time.
KEPT_BY = {"track_samples": ("raw_track_samples_days", "ts_ms"), "track_segments": ("raw_track_samples_days", "to_ts_ms"), "analytics_events": ("events_days", "ts_ms"), "aggregate_snapshots": ("aggregate_snapshots_days", "ts_ms")}


def day(ts_ms: Column) -> Column:
    return F.floor(ts_ms / DAY_MS).cast("int")


def append(rows: DataFrame, table: str, time: str = "ts_ms") -> None:
    """Adds rows to a table of the catalogue, in partitions of days of their time."""
    rows.withColumn("day", day(F.col(time))).write.partitionBy("day").mode("append").saveAsTable(table)


def days_of(spark: SparkSession, table: str) -> list[int]:
    """The days a table has partitions of: names from the catalogue, one for each day."""
    return sorted(int(r[0].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect())


def prune(spark: SparkSession, table: str, days: float | None, now_ms: int, time: str = "ts_ms") -> int | None:
    """Drops rows whose time is more than so many days ago; None keeps all. Gives the time of the cut."""
    if days is None:
        return None
    cut = now_ms - int(days * DAY_MS)
    for d in days_of(spark, table):
        if (d + 1) * DAY_MS <= cut:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (day = {d})")
        elif d * DAY_MS < cut:
            whole = spark.table(table).filter(F.col("day") == d)
            kept = whole.filter(F.col(time) >= cut)
            # a table that is read can't be written: the day is settled first
            settled = kept.checkpoint()
            if settled.isEmpty():
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (day = {d})")
            elif settled.count() < whole.count():
                settled.createOrReplaceTempView("_kept_of_day")
                columns = ", ".join(f"`{c}`" for c in settled.columns if c != "day")
                spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (day = {d}) SELECT {columns} FROM _kept_of_day")
                spark.catalog.dropTempView("_kept_of_day")
    return cut


def prune_all(spark: SparkSession, retention: dict[str, float | None], now_ms: int, prefix: str = "") -> dict[str, int | None]:
    """Every stored table that there is, by its own setting."""
    return {name: prune(spark, prefix + name, retention.get(setting), now_ms, time) for name, (setting, time) in KEPT_BY.items() if spark.catalog.tableExists(prefix + name)}

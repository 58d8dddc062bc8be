"""Several tables of one micro-batch, committed together, with event ids that run on across batches.

A batch's tables are written under its number, then one row of the ledger says which number, which ids and which tables: only what the ledger
names is read. So a batch that fails half-way is not there, and one that is repeated after its commit changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.store import numbered_events

LEDGER = "batch bigint, first_id bigint, n_events bigint, tables array<string>"


class FrameRecords:
    """A folder of tables in whatever store Spark writes to, with its ledger."""

    def __init__(self, folder: str, make: dict[str, Callable[[DataFrame], DataFrame]], events: str = "events", order: tuple[str, ...] = ("ts_ms",), window_s: int = 300, told: Callable[[DataFrame, int], None] | None = None):
        """make: by table, its rows from a batch. The table `events` gets ids in the order of `order`, a time first; a table `snapshots` gets window_s. told: is handed a batch's events with their ids once they are committed."""
        self.folder, self.make, self.events, self.order, self.window_s, self.told = folder, make, events, list(order), window_s, told

    def ledger(self, spark: SparkSession) -> DataFrame:
        """The batches that are committed, one row each."""
        try:
            return spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger_of_batches")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], LEDGER)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table's committed rows."""
        done = [r.batch for r in self.ledger(spark).filter(F.array_contains("tables", name)).select("batch").collect()]
        if not done:
            raise ValueError(f"no batch of {name} is committed")
        return spark.read.parquet(*[f"{self.folder}/{name}/batch={n}" for n in sorted(done)])

    def write(self, batch: DataFrame, number: int) -> None:
        """The function for foreachBatch."""
        spark = batch.sparkSession
        known = self.ledger(spark).agg(F.max(F.when(F.col("batch") == number, True)), F.max(F.col("first_id") + F.col("n_events"))).first()
        if known[0]:
            return
        first = known[1] if known[1] is not None else 1
        batch.persist()
        try:
            counted = 0
            for name, rows in ((n, f(batch)) for n, f in self.make.items()):
                where = f"{self.folder}/{name}/batch={number}"
                if name == self.events:
                    rows = numbered_events(rows, self.order, first - 1, keys=[])
                elif name == "snapshots":
                    rows = rows.withColumn("window_s", F.lit(self.window_s))
                rows.write.mode("overwrite").parquet(where)
                if name == self.events:
                    counted = spark.read.parquet(where).count()
            mark = spark.createDataFrame([(number, first, counted, list(self.make))], LEDGER)
            # a job's files appear when it commits, all at once: this row is the batch's commit
            mark.coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger_of_batches")
        finally:
            batch.unpersist()
        if self.told is not None and self.events in self.make:
            self.told(spark.read.parquet(f"{self.folder}/{self.events}/batch={number}"), number)

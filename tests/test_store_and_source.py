"""The sink's ledger, retention by partitions, the telemetry source and the figures of running queries."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from wayline.operators import analytics as A
from wayline.operators import retention
from wayline.sources import fixtures as X
from wayline.sources import telemetry_source
from wayline.streaming import progress
from wayline.streaming.sink import FrameRecords

SF = "/root/testdata/sf0.001"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def rows_of(obs):
    return {"samples": lambda b: A.with_foot(b), "events": lambda b: b.select("stream_id", "profile", "track_id", "frame_id", "ts_ms").withColumn("kind", F.lit("seen")), "snapshots": lambda b: A.counts(b)}


def test_ids_run_on_and_batches_commit_together(spark, tmp_path):
    obs, told = X.track_obs(spark, SF), []
    sink = FrameRecords(str(tmp_path), rows_of(obs), order=("ts_ms", "stream_id", "track_id"), told=lambda events, n: told.append((n, [r.id for r in events.orderBy("id").collect()])))
    cuts = [obs.filter(c) for c in ("frame_id < 10", "frame_id between 10 and 24", "frame_id > 24")]
    sizes = [c.count() for c in cuts]
    sink.write(cuts[0], 0)
    sink.write(cuts[1], 1)
    assert [(r.batch, r.first_id, r.n_events) for r in sink.ledger(spark).orderBy("batch").collect()] == [(0, 1, sizes[0]), (1, 1 + sizes[0], sizes[1])]
    before = files(tmp_path)
    sink.write(cuts[1], 1)
    assert files(tmp_path) == before and len(told) == 2

    # one table fails after others were written: nothing of the batch is there, and it comes whole when repeated
    broken = FrameRecords(str(tmp_path), {**rows_of(obs), "snapshots": lambda b: b.select(F.raise_error(F.lit("no"))).withColumn("x", F.lit(1))}, order=("ts_ms", "stream_id", "track_id"))
    with pytest.raises(Exception, match="no"):
        broken.write(cuts[2], 2)
    assert sink.table(spark, "events").count() == sizes[0] + sizes[1] == sink.table(spark, "samples").count()
    sink.write(cuts[2], 2)
    events = sink.table(spark, "events").orderBy("id").collect()
    assert [r.id for r in events] == list(range(1, sum(sizes) + 1))
    assert [(r.ts_ms, r.stream_id, r.track_id) for r in events] == sorted((r.ts_ms, r.stream_id, r.track_id) for r in events)
    assert told == [(n, list(range(1 + sum(sizes[:n]), 1 + sum(sizes[: n + 1])))) for n in range(3)]
    assert {r.window_s for r in sink.table(spark, "snapshots").collect()} == {300}


def test_the_sink_in_a_stream(spark, tmp_path):
    obs = X.track_obs(spark, SF)
    for k, cut in enumerate(("frame_id < 20", "frame_id >= 20")):
        obs.filter(cut).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in obs.schema)
    sink = FrameRecords(f"{tmp_path}/out", rows_of(obs), order=("ts_ms", "stream_id", "track_id"))
    for checkpoint in ("a", "b"):
        # the second run has lost its checkpoint: it repeats both batches, and nothing changes
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(sink.write).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination(240)
        assert sink.table(spark, "events").count() == obs.count() and sink.ledger(spark).count() == 2


def test_retention_drops_partitions(spark, tmp_path):
    day = retention.DAY_MS
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    spark.sql("CREATE DATABASE IF NOT EXISTS kept LOCATION '" + str(tmp_path / "db") + "'")
    rows = spark.range(400).select(F.col("id").alias("track_id"), (F.col("id") * (day // 40)).alias("ts_ms"))
    try:
        retention.append(rows, "kept.track_samples")
        retention.append(rows.withColumnRenamed("ts_ms", "to_ts_ms"), "kept.track_segments", "to_ts_ms")
        assert retention.days_of(spark, "kept.track_samples") == list(range(10))
        before = files(tmp_path / "db")
        now = 10 * day
        assert retention.prune(spark, "kept.track_samples", None, now) is None and files(tmp_path / "db") == before
        cut = retention.prune(spark, "kept.track_samples", 3.5, now)
        assert cut == int(6.5 * day)
        assert sorted(r.ts_ms for r in spark.table("kept.track_samples").collect()) == [t for t in range(0, now, day // 40) if t >= cut]
        after = files(tmp_path / "db")
        assert retention.days_of(spark, "kept.track_samples") == [6, 7, 8, 9]
        untouched = {f: t for f, t in before.items() if "track_samples" in f and any(f"day={d}/" in f for d in (7, 8, 9))}
        assert len(untouched) >= 3 and untouched.items() <= after.items()
        assert not [f for f in after if "track_samples" in f and any(f"day={d}/" in f for d in range(6))]
        again = files(tmp_path / "db")
        retention.prune(spark, "kept.track_samples", 3.5, now)
        assert files(tmp_path / "db") == again
        assert retention.prune_all(spark, {"raw_track_samples_days": 2, "events_days": 1}, now, "kept.") == {"track_samples": 8 * day, "track_segments": 8 * day}
        assert spark.table("kept.track_segments").count() == 80 and spark.table("kept.track_samples").count() == 80
    finally:
        spark.sql("DROP DATABASE kept CASCADE")


def message(k):
    if k % 5 == 1:
        return {"metrics": {"uptime_s": k}}
    if k % 5 == 2:
        return {"status": {"state": "up", "n": k}}
    if k % 5 == 3:
        return {"log": {"message": "é" * (k % 7)}}
    return {"frame": {"stream": {"stream_id": f"cam{k % 3}"}, "frame_id": str(k), "pts_ns": str(k * 10**9), "width": 1280, "height": 720, "tracks": [{"id": 1, "x": 1, "y": 2.5, "w": 3, "h": 4, "score": 0.5}] * (k % 3)}}


def test_telemetry_in_batch_with_options(spark, tmp_path):
    telemetry_source.register(spark)
    lines = [json.dumps(message(k), ensure_ascii=False) for k in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:120]) + "\nno json\n[]\n\n{\"frame\": 3}\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[120:]) + "\n" + lines[0][:20])
    (tmp_path / "_hidden").write_text(lines[0] + "\n")
    for step in (1, 50, 1 << 20):
        got = spark.read.format("telemetry").option("bytes_per_partition", step if step > 1 else 300).load(str(tmp_path))
        kinds = {r.kind: r["count"] for r in got.groupBy("kind").count().collect()}
        assert kinds == {"frame": 80, "metrics": 40, "status": 40, "log": 40}
        frames = {r.frame_id: r for r in got.filter("kind = 'frame'").collect()}
        assert all(frames[k].stream_id == f"cam{k % 3}" and frames[k].pts_ns == k * 10**9 and len(frames[k].tracks) == k % 3 and frames[k].profile == "ui" for k in range(200) if k % 5 in (0, 4))
    some = spark.read.format("telemetry").option("streams", "cam1,cam2").option("metrics", "false").option("logs", "FALSE").load(str(tmp_path))
    assert {r.kind for r in some.collect()} == {"frame", "status"} and {r.stream_id for r in some.filter("kind = 'frame'").collect()} == {"cam1", "cam2"}
    assert {r.kind for r in spark.read.format("telemetry").option("frames", "false").load(str(tmp_path)).collect()} == {"metrics", "status", "log"}


def test_telemetry_stream_loses_and_repeats_nothing(spark, tmp_path):
    """Files grow between runs, a line is half-written when a run ends, and a file comes later."""
    telemetry_source.register(spark)
    folder, lines = tmp_path / "in", [json.dumps(message(k)) for k in range(90)]
    folder.mkdir()

    def run():
        q = spark.readStream.format("telemetry").option("bytes_per_partition", 700).load(str(folder)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.schema(telemetry_source.SCHEMA).parquet(f"{tmp_path}/out").collect()

    a, b = folder / "a", folder / "b"
    a.write_text("\n".join(lines[:30]) + "\n" + lines[30][:15])
    assert len(run()) == 30
    a.write_text("\n".join(lines[:50]) + "\n")
    assert len(run()) == 50
    assert len(run()) == 50
    b.write_text("\n".join(lines[50:]) + "\n")
    got = run()
    assert len(got) == 90 and len({(r.file, r.at) for r in got}) == 90
    assert sorted(r.frame_id for r in got if r.kind == "frame") == [k for k in range(90) if k % 5 in (0, 4)]


def test_figures_of_a_running_query(spark, tmp_path):
    """Messages keep coming while a batch is at work: the report after it tells what waits."""
    telemetry_source.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps(message(k)) + "\n" for k in range(60)]
    (folder / "a").write_text("".join(lines[:40]))
    listener = progress.Progress(waiting={"figures": telemetry_source.waiting(str(folder))})

    def work(batch, number):
        batch.count()
        if number == 0:
            (folder / "b").write_text("".join(lines[40:]))

    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.format("telemetry").load(str(folder))
        q = stream.writeStream.queryName("figures").foreachBatch(work).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="5 seconds").start()
        import time

        end = time.time() + 120
        while time.time() < end and sum(r[4] for r in listener.rows.get("figures", ())) < 60:
            time.sleep(0.2)
        q.stop()
    finally:
        spark.streams.removeListener(listener)
    rows = listener.table(spark).filter("query = 'figures'")
    assert rows.agg(F.sum("n_rows")).first()[0] == 60
    (first,) = progress.queue_figures(rows.filter("batch = 0"), 100).collect()
    assert first.size == sum(map(len, lines[40:])) and first.high and first.capacity == 100
    (last,) = progress.queue_figures(rows, 100).collect()
    assert (last.size, last.dropped, last.high) == (0, 0, False)
    summary = spark.createDataFrame([("cam0", 3)], "stream_id string, n_events bigint")
    told = progress.with_figures(summary, progress.queue_figures(rows, 100), {"events_days": 7, "raw_track_samples_days": None}).first()
    assert told.queue.capacity == 100 and told.retention.events_days == 7.0 and told.retention.raw_track_samples_days is None
    assert progress.with_figures(summary, progress.queue_figures(rows.limit(0), 100), {"events_days": 1}).first().queue is None

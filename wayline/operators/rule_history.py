"""Rules as a table of changes: what each rule was at any time, and crossings judged by the rule then in force.

Changes are (stream_id, profile, id, seq, at_ms, op, kind, name, enabled, geometry, settings); seq orders a rule's changes. A `put` sets
all fields of a rule: a new one is created then, a known one keeps its time of creation. A `patch` sets the fields that aren't null
and does nothing to a rule that isn't there. A `delete` ends a rule; one put later is another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators import analytics as A
from wayline.operators.sequence import gated, with_last, with_previous

RULE = ["stream_id", "profile", "id"]
#: A segment meets the versions of its bucket, those in force throughout and those that begin or end in it; the longer a bucket, the more of the latter.
BUCKET_MS = 2000
FIELDS = ["kind", "name", "enabled", "geometry", "settings"]


def judged(changes: DataFrame) -> DataFrame:
    """Changes with `live` (whether there was such a rule just before) and `effective` (whether the change did anything)."""
    life = {"_life": F.when(F.col("op").isin("put", "delete"), F.col("op"))}
    known = with_last(changes, RULE, "seq", life, inclusive=False).withColumn("live", F.coalesce(F.col("_life") == "put", F.lit(False)))
    return known.withColumn("effective", F.col("live") | (F.col("op") == "put")).drop("_life")


def versions(changes: DataFrame) -> DataFrame:
    """Every state of every rule: its fields, created_at_ms, updated_at_ms, and from when to when it was in force (valid_to_ms null: still is).

    Long histories are cut into spans of seq, so a rule that changes much is no busy task.
    """
    done = judged(changes).filter("effective")
    timed = with_previous(done, RULE, "seq", ["at_ms"], following=("at_ms",)).drop("prev_at_ms")
    set_ = {c: F.col(c) for c in FIELDS} | {"created_at_ms": F.when((F.col("op") == "put") & ~F.col("live"), F.col("at_ms"))}
    whole = with_last(timed.withColumn("created_at_ms", F.lit(None).cast("bigint")), RULE, "seq", set_)
    return whole.filter("op <> 'delete'").select(*RULE, "seq", "op", *FIELDS, "created_at_ms", F.col("at_ms").alias("updated_at_ms"), F.col("at_ms").alias("valid_from_ms"), F.col("next_at_ms").alias("valid_to_ms"))


def in_force(versions_: DataFrame, at_ms: int | None = None) -> DataFrame:
    """The rules as they are (at a time, or at the end of the history), as the store keeps them."""
    if at_ms is None:
        now = versions_.filter("valid_to_ms is null")
    else:
        now = versions_.filter((F.col("valid_from_ms") <= at_ms) & (F.col("valid_to_ms").isNull() | (F.col("valid_to_ms") > at_ms)))
    return now.select("id", "stream_id", "profile", "kind", "name", "enabled", "geometry", "settings", "created_at_ms", "updated_at_ms")


def changes_after(changes: DataFrame, at_ms: int, op: str) -> DataFrame:
    """Each rule's next change after a time, where it is of this kind."""
    following = changes.filter(F.col("at_ms") > at_ms).groupBy(*RULE).agg(F.min_by(F.struct("op", *FIELDS), "seq").alias("_c"))
    return following.filter(F.col("_c.op") == op).select(*RULE, *[F.col(f"_c.{c}").alias(c) for c in FIELDS])


def line_candidates(obs: DataFrame, versions_: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Segments that cross a line of their stream as it was at the segment's end.

    An as-of join by buckets of time: a version stands in each bucket in which it is in force, up to the last observation, so that
    segments meet only versions of their stream and bucket, and a busy stream is dealt out by time.
    """
    end = obs.agg(F.max("ts_ms")).first()[0] or 0
    bucket = lambda ts: F.floor(ts / bucket_ms)
    lines = A.line_rules(versions_, "valid_from_ms", "valid_to_ms").filter(F.col("valid_from_ms") <= end)
    upto = F.least(F.coalesce(F.col("valid_to_ms") - 1, F.lit(end)), F.lit(end))
    spread = lines.filter(upto >= F.col("valid_from_ms")).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("valid_from_ms")), bucket(upto))))
    met = A.segments(obs).withColumn("_bucket", bucket(F.col("to_ts_ms"))).join(spread, [*A.P, "_bucket"])
    then = (F.col("to_ts_ms") >= F.col("valid_from_ms")) & (F.col("valid_to_ms").isNull() | (F.col("to_ts_ms") < F.col("valid_to_ms")))
    return A.crossings(met.filter(then), "valid_from_ms")


def line_events(obs: DataFrame, versions_: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """The candidates that stand the gap of the version then in force after the last event of the same rule, track and direction; a change of the rule keeps that last event."""
    found = line_candidates(obs, versions_, bucket_ms)
    return gated(found, [*A.T, "rule_id", "direction"], "ts_ms", F.col("gap_ms"))

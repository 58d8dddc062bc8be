"""Rules, events and snapshots as tables: the queries that serve them and the changes that keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = ["stream_id", "profile"]


def matching(rows: DataFrame, **wanted: object) -> DataFrame:
    """The rows that equal all values given; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def rules_of(rules: DataFrame, stream_id: str | None = None, profile: str | None = "ui", enabled_only: bool = False) -> DataFrame:
    """A stream's rules, oldest first."""
    found = matching(rules, stream_id=stream_id, profile=profile)
    return (found.filter("enabled") if enabled_only else found).orderBy("created_at_ms", "id")


def patched(rules: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Rules with the fields that a change of the same stream and id sets; what it leaves null stays, created_at_ms always does."""
    fields = [c for c in changes.columns if c not in (*P, "id")]
    new = changes.select(*P, "id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    met = rules.join(new, [*P, "id"], "left")
    updated = F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col("updated_at_ms"))
    set_ = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields} | {"updated_at_ms": updated}
    return met.select(*[set_[c].alias(c) if c in set_ else F.col(c) for c in rules.columns])


def deleted(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """Rules without those in gone."""
    return rules.join(gone, gone.columns, "left_anti").select(*rules.columns)


def newest_events(events: DataFrame, limit: int = 100, **wanted: object) -> DataFrame:
    """The newest events that match, at most limit of them, which is held within 1 to 1000."""
    return matching(events, **wanted).orderBy(F.col("ts_ms").desc(), F.col("id").desc()).limit(min(max(limit, 1), 1000))


def since(now_ms: Column, window_s: int) -> Column:
    """Where a trailing window begins; its length is held within a second and a day."""
    return now_ms - min(max(window_s, 1), 86_400) * 1000


def count_since(events: DataFrame, since_ms: Column, **wanted: object) -> DataFrame:
    return matching(events, **wanted).filter(F.col("ts_ms") >= since_ms).groupBy(*P).agg(F.count("*").alias("n_events"))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by order; a partial aggregate, so a busy key is no busy task."""
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return top.select("_row.*")


def with_retention(rows: DataFrame, days: int | None, now_ms: int) -> DataFrame:
    """Rows that are not older than days; None keeps all."""
    return rows if days is None else rows.filter(F.col("ts_ms") >= now_ms - days * 86_400_000)


def numbered_events(events: DataFrame, order: list[str], start: int = 0, span: int = 600_000, keys: list[str] = P) -> DataFrame:
    """Ids in emission order within each stream (or among all, without keys), as an append would give them; order begins with a time.

    Events are cut into spans of that time: rows are numbered within a span, and a row per span carries over the number
    of those before it.
    """
    spanned = events.withColumn("_span", F.floor(F.col(order[0]) / span))
    sizes = spanned.groupBy(*keys, "_span").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    carried = sizes.select(*keys, "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = spanned.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(*order)))
    return placed.join(carried, [*keys, "_span"]).select(*events.columns, (F.col("_place") + F.col("_before") + start).cast("bigint").alias("id"))


def upserted(rules: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """Rules with those in new (all fields of a rule but its times) put in: a known id of a stream takes the new fields and keeps its
    time of creation, any other begins now; one without an id gets a random one."""
    named = new.withColumn("id", F.coalesce("id", F.expr("uuid()")))
    known = rules.select(*P, "id", F.col("created_at_ms").alias("_created"))
    put = named.join(known, [*P, "id"], "left").withColumns({"created_at_ms": F.coalesce("_created", F.lit(now_ms)), "updated_at_ms": F.lit(now_ms)})
    return rules.join(named.select(*P, "id"), [*P, "id"], "left_anti").select(*rules.columns).union(put.select(*rules.columns))


def with_persisted(recent: DataFrame, persisted: DataFrame, most: int = 50) -> DataFrame:
    """The newest events that a stream shows (recent: events, newest first) after some of its own were stored: those, with their ids, in
    the order in which they came out, then what recent holds beyond as many."""
    stored = persisted.groupBy(*P).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "kind"))), lambda e: F.struct(e["id"].alias("id"), e["kind"].alias("kind"))).alias("_stored"))
    older = F.slice("events", F.size("_stored") + 1, F.lit(most))
    return recent.join(stored, P, "left").withColumn("events", F.when(F.col("_stored").isNull(), F.col("events")).otherwise(F.concat("_stored", older))).drop("_stored")


def snapshots_shown(streams: DataFrame, latest_: DataFrame, rules: DataFrame, rows: int = 36, cols: int = 64) -> DataFrame:
    """Each stream's latest snapshot (heat: its grid), or an empty one with all cells 0 where it has none; with the names of its rules."""
    names = rules.groupBy(*P).agg(F.array_sort(F.collect_list("id")).alias("rules"))
    met = streams.join(latest_, P, "left").join(names, P, "left")
    none = F.array().cast("array<string>")
    return met.withColumns({"empty": F.col("ts_ms").isNull(), "heat": F.coalesce("heat", F.array_repeat(F.lit(0.0), rows * cols)), "active": F.coalesce("active", F.lit(0)), "rules": F.coalesce("rules", none)})

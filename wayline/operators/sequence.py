"""Order-dependent columns over long sequences, without one task per key.

A key's rows are cut into spans of the order column; windows work within a span, and one row per span carries over what a span needs from
those before it. A key that holds a third of all rows thus takes as many tasks as it has spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def dealt(df: DataFrame, keys: list[str], order: str, span: int, **values: Column) -> DataFrame:
    """Rows dealt out by key and span: (keys, order, _span, values, _row), _row being all other columns as one.

    What works within spans and what carries over from span to span read this one exchange: as both take whole rows, Spark plans it once.
    The span is never null, so that no filter is put under one of the two only.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(True).alias("_none"))
    at = F.coalesce(F.floor(F.col(order) / span), F.lit(0).cast("bigint")).alias("_span")
    return df.select(*keys, order, at, *[v.alias(k) for k, v in values.items()], row.alias("_row")).repartition(*keys, "_span")


def _columns(df: DataFrame, keys: list[str], order: str, but: Iterable[str] = ()) -> list[Column]:
    """The columns of df out of its dealt rows."""
    return [F.col(c) if c in keys or c == order else F.col("_row")[c].alias(c) for c in df.columns if c not in but]


def with_previous(df: DataFrame, keys: list[str], order: str, columns: list[str], prefix: str = "prev_", span: int = SPAN, following: tuple[str, ...] = ()) -> DataFrame:
    """Adds prev_<c>: column c of the row before, by order, among rows of equal keys, and next_<c> of the row after; null where there is none."""
    spanned = dealt(df, keys, order, span)
    row = F.struct(order, "_row")
    within = Window.partitionBy(*keys, "_span").orderBy(order)
    ends = spanned.groupBy(*keys, "_span").agg(F.max_by(row, F.col(order)).alias("_last"), *([F.min_by(row, F.col(order)).alias("_first")] if following else []))
    across = Window.partitionBy(*keys).orderBy("_span")
    carried = ends.select(*keys, "_span", F.lag("_last").over(across).alias("_carried"), *([F.lead("_first").over(across).alias("_coming")] if following else []))
    near = {"_before": F.lag(row).over(within)} | ({"_after": F.lead(row).over(within)} if following else {})
    met = spanned.withColumns(near).join(carried, [*keys, "_span"])
    before, then = F.coalesce("_before", "_carried"), F.coalesce("_after", "_coming") if following else None
    of = lambda side, c: side[c] if c == order else side["_row"][c]
    return met.select(*_columns(df, keys, order), *[of(before, c).alias(prefix + c) for c in columns], *[of(then, c).alias("next_" + c) for c in following])


def with_running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, of=F.sum, none: object = 0, span: int = SPAN) -> DataFrame:
    """Adds `of` (a sum, a maximum) over the rows of equal keys up to and with this one; `none` is what a key has before its first span."""
    spanned = dealt(df, keys, order, span, _value=value)
    parts = spanned.groupBy(*keys, "_span").agg(of("_value").alias("_part"), F.max_by("_row", order).alias("_whole"))
    over = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.filter("_whole is not null").select(*keys, "_span", F.coalesce(of("_part").over(over), F.lit(none)).alias("_carried"))
    within = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = spanned.withColumn("_run", of("_value").over(within)).join(carried, [*keys, "_span"])
    both = F.greatest("_run", "_carried") if of is F.max else F.col("_run") + F.col("_carried")
    return met.select(*_columns(df, keys, order), both.alias(name))


def with_running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """Adds the sum of value over the rows of equal keys up to and with this one."""
    return with_running(df, keys, order, value, name, span=span)


def with_last(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], inclusive: bool = True, span: int = SPAN) -> DataFrame:
    """Adds, by name, the last value that isn't null among the rows of equal keys up to this one (with it, if inclusive); a name may be that of a column."""
    spanned = dealt(df, keys, order, span, **{f"_v_{c}": v for c, v in values.items()})
    ends = spanned.groupBy(*keys, "_span").agg(F.max_by("_row", order).alias("_whole"), *[F.max_by(F.col(f"_v_{c}"), F.when(F.col(f"_v_{c}").isNotNull(), F.col(order))).alias(f"_e_{c}") for c in values])
    over = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.filter("_whole is not null").select(*keys, "_span", *[F.last(f"_e_{c}", ignorenulls=True).over(over).alias(f"_c_{c}") for c in values])
    within = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    near = spanned.withColumns({f"_l_{c}": F.last(f"_v_{c}", ignorenulls=True).over(within) for c in values}).join(carried, [*keys, "_span"])
    return near.select(*_columns(df, keys, order, values), *[F.coalesce(f"_l_{c}", f"_c_{c}").alias(c) for c in values])


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables that hold whole runs of equal keys, about so many rows each, with the rows at which runs begin."""
    held: list[pa.RecordBatch] = []

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = begins(table)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            held = table.slice(starts[-1]).to_batches()
    if held and sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, begins(table)


def _next_kept(times: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Of each time, were it kept, the place of the one that is kept next: the first after it that stands its own gap beyond. The number of times if none does."""
    after = np.full(len(times), len(times))
    for gap in np.unique(gaps):
        some = np.flatnonzero(gaps == gap)
        # the first of this gap that stands far enough, and the first that comes later in the order
        at = np.maximum(np.searchsorted(times[some], times + gap), np.searchsorted(some, np.arange(len(times)), side="right"))
        after = np.minimum(after, np.append(some, len(times))[at])
    return after


def gate_table(times: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a span of ascending times makes of any gate that reaches it.

    A time is kept first if it is the first that stands its gap beyond the last time kept before: the first of times - gaps to reach that one, so only records of it
    come into question, and as the last time before is below the span's first, none after the first record that reaches that. Ascending, with the time
    that is kept last if it is the first.
    """
    n, after, far = len(times), _next_kept(times, gaps), times - gaps
    last = np.where(after == n, np.arange(n), np.minimum(after, n - 1))
    while not np.array_equal(jumped := last[last], last):
        last = jumped
    records = np.flatnonzero(far > np.append(np.iinfo(np.int64).min, np.maximum.accumulate(far)[:-1]))
    records = records[: int(np.searchsorted(far[records], times[0])) + 1]
    return far[records], times[last[records]]


def gated(rows: DataFrame, keys: list[str], time: str, gap: Column, span: int = 600_000) -> DataFrame:
    """Of each key's times in ascending order, those that stand at least their gap after the last one kept: (keys, time).

    What is kept depends on what was kept before, and still no key is one task: its times are cut into spans of `span`, and each span
    says what it makes of every last kept time that may reach it, which is a short table. These tables, a row a span, are
    composed in order; then each span keeps its own from the time that does reach it.
    """
    given = rows.select(*keys, F.col(time).cast("bigint").alias(time), gap.cast("bigint").alias("_gap"), F.floor(F.col(time) / span).alias("_span"))
    by = [*keys, "_span"]
    cut = given.repartition(*by).sortWithinPartitions(*by, time, "_gap")
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*by).schema)

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, by):
            times, gaps, ends = table.column(time).to_numpy(), table.column("_gap").to_numpy(), np.append(starts[1:], table.num_rows)
            made = [gate_table(times[a:b], gaps[a:b]) for a, b in zip(starts, ends, strict=True)]
            heads = table.select(by).take(pa.array(starts))
            arrays = [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (0, 1)]
            yield from heads.append_column("_reached", arrays[0]).append_column("_kept_last", arrays[1]).combine_chunks().to_batches()

    def composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            entry = []
            for key, reached, then in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("_reached"), batch.column("_kept_last"), strict=True):
                if key != now:
                    now, last = key, None
                entry.append(last)
                at = 0 if last is None else int(np.searchsorted(reached.values.to_numpy(), last))
                if at < len(reached):
                    last = then.values[at].as_py()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in by), pa.array(entry, pa.int64())], names=[*by, "_entry"])

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, by):
            times, gaps, entry, some = table.column(time).to_numpy(), table.column("_gap").to_numpy(), table.column("_entry").to_pylist(), []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                after = _next_kept(times[a:b], gaps[a:b]).tolist()
                at = 0
                if entry[a] is not None:
                    far = times[a:b] - gaps[a:b] >= entry[a]
                    at = int(far.argmax()) if far.any() else b - a
                while at < b - a:
                    some.append(a + at)
                    at = after[at]
            yield from table.select([*keys, time]).take(pa.array(some, pa.int64())).combine_chunks().to_batches()

    spans = cut.mapInArrow(tables, f"{named}, _reached array<bigint>, _kept_last array<bigint>")
    entries = spans.repartition(*keys).sortWithinPartitions(*by).mapInArrow(composed, f"{named}, _entry bigint")
    met = cut.join(entries, by)
    return met.sortWithinPartitions(*by, time, "_gap").mapInArrow(kept, given.select(*keys, time).schema)

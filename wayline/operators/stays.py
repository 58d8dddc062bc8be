"""Stays in areas as a state machine that is run span by span.

Per track and rule the state is whether the track is inside, since when, whether the dwell threshold has been told, and the seconds of stays
that ended. A span of frames is run without knowing the state that reaches it: whether a stay comes in is seen from its first row, and all
that depends on its beginning is left open in one row, a piece. Pieces, one per track, rule and span, are composed in order; what they left open is
filled in, and the seconds of earlier spans are added to those of later ones. A track of a third of all rows thus takes as many tasks as it has spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.sequence import SPAN, whole_runs

AT = "struct<frame_id: bigint, ts_ms: bigint, foot_x: double, foot_y: double>"
_AT = pa.struct([("frame_id", pa.int64()), ("ts_ms", pa.int64()), ("foot_x", pa.float64()), ("foot_y", pa.float64())])
WALKED = f"kind string, at {AT}, dwell_s double, total_s double, piece struct<carried: boolean, threshold_s: double, open_ms: bigint, told: boolean, ended: {AT}, records: array<{AT}>, seconds: double>"
_PIECE = pa.struct([("carried", pa.bool_()), ("threshold_s", pa.float64()), ("open_ms", pa.int64()), ("told", pa.bool_()), ("ended", _AT), ("records", pa.list_(_AT)), ("seconds", pa.float64())])
KINDS = ("area_enter", "area_dwell_threshold", "area_exit")


def walk(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, pa.Table]:
    """The events of some runs (one track, rule and span each, by frame) and a piece for each: rows to take keys from, and WALKED."""
    n = table.num_rows
    column = lambda c: table.column(c).to_numpy()
    frame, ts, x, y, inside, was, lost = (column(c) for c in ("frame_id", "ts_ms", "foot_x", "foot_y", "inside", "was", "lost"))
    threshold = column("threshold_s").astype(float)  # null is NaN, which nothing reaches
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    enters = inside & ~was
    entry = np.maximum.accumulate(np.where(enters, np.arange(n), -1))
    carried = entry < starts[run]
    spent = np.where(carried, np.nan, np.maximum(0.0, (ts - ts[entry]) / 1000))
    long = inside & was & (spent >= threshold)
    tells = np.zeros(n, bool)
    tells[np.flatnonzero(long)[np.unique(entry[long], return_index=True)[1]]] = True
    leaves = was & ~inside | lost
    out_frame, out_ts = np.where(lost, column("next_frame_id"), frame).astype(np.int64), np.where(lost, column("next_ts_ms"), ts).astype(np.int64)
    exits = np.flatnonzero(leaves & ~carried)
    stayed = np.maximum(0.0, (out_ts[exits] - ts[entry[exits]]) / 1000)
    upto = np.cumsum(stayed)
    before = np.append(0.0, upto)[np.searchsorted(exits, starts)]
    seconds = np.append(0.0, upto)[np.searchsorted(exits, np.append(starts[1:], n))] - before
    rows = np.concatenate([np.flatnonzero(enters), np.flatnonzero(tells), exits])
    kinds = np.repeat([0, 1, 2], [enters.sum(), tells.sum(), len(exits)])
    is_exit = kinds == 2
    at_frame, at_ts = np.where(is_exit, out_frame[rows], frame[rows]), np.where(is_exit, out_ts[rows], ts[rows])
    dwell = np.full(len(rows), np.nan)
    dwell[kinds == 1], dwell[is_exit] = spent[rows[kinds == 1]], stayed
    total = np.full(len(rows), np.nan)
    total[is_exit] = upto - before[run[exits]]

    def at(frames, times, some) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(frames, pa.int64()), pa.array(times, pa.int64()), pa.array(x[some]), pa.array(y[some])], fields=list(_AT))

    # a piece: what came in, what goes out, and of the rows between those that may be the first to reach the threshold, whatever the beginning
    last = np.append(starts[1:], n) - 1
    goes_out = inside[last] & ~lost[last] & ~carried[last]
    told = np.zeros(n, bool)
    told[entry[tells]] = True
    ended = np.full(len(starts), -1)
    closing = np.flatnonzero(carried & leaves)
    ended[run[closing]] = closing
    open_ = carried & inside & was & ~np.isnan(threshold)
    pieces = []
    for r, first in enumerate(starts.tolist()):
        e, came, beyond = int(ended[r]), bool(carried[first]), int(entry[last[r]])
        records = None
        if came:
            some = np.flatnonzero(open_[first : last[r] + 1]) + first
            some = some[ts[some] > np.append(-np.inf, np.maximum.accumulate(ts[some])[:-1])] if len(some) else some
            records = [{"frame_id": int(frame[i]), "ts_ms": int(ts[i]), "foot_x": float(x[i]), "foot_y": float(y[i])} for i in some]
        pieces.append({
            "carried": came, "threshold_s": None if np.isnan(threshold[first]) else float(threshold[first]), "open_ms": int(ts[beyond]) if goes_out[r] else None, "told": bool(told[beyond]) if goes_out[r] else None,
            "ended": None if e < 0 else {"frame_id": int(out_frame[e]), "ts_ms": int(out_ts[e]), "foot_x": float(x[e]), "foot_y": float(y[e])}, "records": records, "seconds": float(seconds[r]),
        })
    m, k = len(rows), len(starts)
    made = pa.table({
        "kind": pa.concat_arrays([pa.array(np.array(KINDS, object)[kinds], pa.string()), pa.nulls(k, pa.string())]),
        "at": pa.concat_arrays([at(at_frame, at_ts, rows), pa.nulls(k, _AT)]),
        "dwell_s": pa.concat_arrays([pa.array(dwell, from_pandas=True), pa.nulls(k, pa.float64())]),
        "total_s": pa.concat_arrays([pa.array(total, from_pandas=True), pa.nulls(k, pa.float64())]),
        "piece": pa.concat_arrays([pa.nulls(m, _PIECE), pa.array(pieces, _PIECE)]),
    })
    return np.concatenate([rows, starts]), made


def stay_events(seen: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """Events of (keys, frame_id, ts_ms, foot_x, foot_y, inside, was, lost, next_frame_id, next_ts_ms, threshold_s).

    was: inside in the frame before; lost: inside, and not seen in the frame after, next_*. Rows that are neither inside nor were have no part in it.
    """
    given = seen.filter("inside or was").select(
        *keys, F.floor(F.col("frame_id") / span).alias("_span"), *[F.col(c).cast("bigint").alias(c) for c in ("frame_id", "ts_ms", "next_frame_id", "next_ts_ms")], "foot_x", "foot_y", "inside", "was", "lost", F.col("threshold_s").cast("double")
    )
    by = [*keys, "_span"]
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*by).schema)

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, by):
            rows, made = walk(table, starts)
            heads = table.select(by).take(pa.array(rows))
            yield from pa.table([*heads.columns, *made.columns], names=[*by, *made.column_names]).combine_chunks().to_batches()

    # both uses of what is walked read one exchange; the walk is cheap beside it
    done = given.repartition(*by).sortWithinPartitions(*by, "frame_id").mapInArrow(walked, f"{named}, {WALKED}")
    pieces = done.filter("piece is not null").select(*by, "piece.*")
    order = Window.partitionBy(*keys).orderBy("_span")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    came = F.last(F.when(F.col("open_ms").isNotNull(), F.struct("open_ms", "told", "_span")), ignorenulls=True).over(upto)
    since = lambda ts: F.greatest(F.lit(0.0), (ts - F.col("_came.open_ms")) / 1000)
    met = pieces.withColumn("_came", F.when(F.col("carried"), came))
    met = met.withColumns({
        "_cross": F.get(F.filter("records", lambda r: since(r["ts_ms"]) >= F.col("threshold_s")), 0),
        "_stayed": F.when(F.col("ended").isNotNull(), since(F.col("ended.ts_ms"))),
    })
    of_stay = Window.partitionBy(*keys, F.col("_came._span")).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumns({
        "_told": F.col("_came.told") | F.coalesce(F.max(F.col("_cross").isNotNull()).over(of_stay), F.lit(False)),
        "_earlier": F.coalesce(F.sum(F.col("seconds") + F.coalesce("_stayed", F.lit(0.0))).over(upto), F.lit(0.0)) + F.coalesce("_stayed", F.lit(0.0)),
    })
    none = F.lit(None).cast("double")
    event = lambda when, kind, at, dwell, total: F.when(when, F.struct(F.lit(kind).alias("kind"), at.alias("at"), dwell.alias("dwell_s"), total.alias("total_s")))
    late = F.array(
        event(F.col("_cross").isNotNull() & ~F.col("_told"), KINDS[1], F.col("_cross"), since(F.col("_cross.ts_ms")), none), event(F.col("_stayed").isNotNull(), KINDS[2], F.col("ended"), F.col("_stayed"), F.col("_earlier"))
    )
    filled = met.select(*keys, F.explode(F.array_compact(late)).alias("e")).select(*keys, "e.*")
    own = done.filter("kind is not null").join(met.select(*by, "_earlier"), by).select(*keys, "kind", "at", "dwell_s", (F.col("total_s") + F.col("_earlier")).alias("total_s"))
    return own.union(filled).select(*keys, "kind", "at.*", F.round("dwell_s", 3).alias("dwell_s"), F.round("total_s", 3).alias("total_dwell_s"))

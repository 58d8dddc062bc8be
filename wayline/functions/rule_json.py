"""Lines, polygons and settings out of a rule's JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_XY = "struct<x:double,y:double>"


def _first(json: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def point(json: Column) -> Column:
    """{x, y} or [x, y, ...] to a struct; null for anything else."""
    x = _first(json, "$.x", "$[0]").try_cast("double")
    y = _first(json, "$.y", "$[1]").try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def line(geometry: Column) -> tuple[Column, Column]:
    """The two ends of a line: the first two of points, else from-to, p1-p2 or start-end."""
    start = F.coalesce(*[point(F.get_json_object(geometry, f"$.{n}")) for n in ("points[0]", "from", "p1", "start")])
    end = F.coalesce(*[point(F.get_json_object(geometry, f"$.{n}")) for n in ("points[1]", "to", "p2", "end")])
    return start, end


def polygon(geometry: Column) -> Column:
    """The corners under points or polygon, without those that can't be read."""
    raw = F.from_json(_first(geometry, "$.points", "$.polygon"), "array<string>")
    return F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), point), lambda p: p.isNotNull())


def gap_ms(settings: Column) -> Column:
    """Least time between two events of a line; 0 counts as not given."""
    given = lambda n: F.nullif(F.get_json_object(settings, f"$.{n}").try_cast("bigint"), F.lit(0))
    return F.coalesce(given("min_gap_ms"), given("debounce_ms"), F.lit(1000)).cast("bigint")


def dwell_threshold(settings: Column) -> Column:
    """Seconds after which a stay is reported; 0 counts, null doesn't."""
    return F.get_json_object(settings, "$.dwell_threshold_s").try_cast("double")

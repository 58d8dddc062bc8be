"""Geometry of boxes, lines and polygons as Column expressions; nothing here leaves whole-stage code generation but polygons and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of a box's height at which its foot stands, and the tolerance of the touch tests; fixed values.
FOOT_SHARE, TOUCH = 0.95, 1e-9


def foot(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Where a box stands: the middle of its width, a little above its lower edge."""
    return x + w / 2, y + h * FOOT_SHARE


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def side_of_line(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Positive, negative or zero as p lies to one side of the line from a to b, to the other, or on it."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segment a-b and segment c-d cross or touch."""
    o1, o2 = side_of_line(ax, ay, bx, by, cx, cy), side_of_line(ax, ay, bx, by, dx, dy)
    o3, o4 = side_of_line(cx, cy, dx, dy, ax, ay), side_of_line(cx, cy, dx, dy, bx, by)

    def touches(o: Column, px, py, qx, qy, rx, ry) -> Column:
        between = lambda p, q, r: (r >= F.least(p, q) - TOUCH) & (r <= F.greatest(p, q) + TOUCH)
        return (F.abs(o) <= TOUCH) & between(px, qx, rx) & between(py, qy, ry)

    crosses = (F.signum(o1) * F.signum(o2) < 0) & (F.signum(o3) * F.signum(o4) < 0)
    return crosses | touches(o1, ax, ay, bx, by, cx, cy) | touches(o2, ax, ay, bx, by, dx, dy) | touches(o3, cx, cy, dx, dy, ax, ay) | touches(o4, cx, cy, dx, dy, bx, by)


def boxes_near(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the boxes around two segments touch: a cheap test before segments_meet."""
    apart = lambda p, q, r, s: (F.greatest(p, q) < F.least(r, s) - TOUCH) | (F.greatest(r, s) < F.least(p, q) - TOUCH)
    return ~(apart(ax, bx, cx, dx) | apart(ay, by, cy, dy))


def in_polygon(points: Column, px: Column, py: Column) -> Column:
    """Even-odd test against an array of (x, y); fewer than three corners hold nothing."""
    n = F.size(points)
    before = F.concat(F.slice(points, n, F.lit(1)), F.slice(points, F.lit(1), n - 1))

    def hit(c: Column, p: Column) -> Column:
        rises = (c["y"] > py) != (p["y"] > py)
        at = (p["x"] - c["x"]) * (py - c["y"]) / F.when(p["y"] == c["y"], F.lit(1.0)).otherwise(p["y"] - c["y"]) + c["x"]
        return (rises & (px < at)).cast("int")

    odd = F.aggregate(F.zip_with(points, before, hit), F.lit(0), lambda n, h: n + h) % 2 == 1
    return F.when(n < 3, F.lit(False)).otherwise(odd)


def direction(from_side: Column, to_side: Column) -> Column:
    """The name of a change of side; null where the side stays."""
    return (
        F.when((from_side == 0) | (to_side == 0), "on_line")
        .when((from_side < 0) & (to_side > 0), "negative_to_positive")
        .when((from_side > 0) & (to_side < 0), "positive_to_negative")
    )


def grid_cell(x: Column, y: Column, width: Column, height: Column, rows: int, cols: int) -> Column:
    """Cell number, row by row, of a point clamped into the frame; null for a frame without area."""
    place = lambda v, size, n: F.least(F.floor(F.least(F.greatest(v, F.lit(0.0)), size - 1e-6) / size * n), F.lit(n - 1))
    return F.when((width > 0) & (height > 0), place(y, height, rows) * cols + place(x, width, cols)).cast("long")


def scene_cell(x: Column, y: Column, width: Column, height: Column, rows: int, cols: int) -> Column:
    """Cell number on the tracker's grid, which clamps to the last whole pixel and has cell 0 for a frame without area."""
    place = lambda v, size, n: F.greatest(F.lit(0), F.least(F.floor(F.least(F.greatest(v, F.lit(0.0)), size - 1.0) / size * n), F.lit(n - 1)))
    return F.when((width > 0) & (height > 0), place(y, height, rows) * cols + place(x, width, cols)).otherwise(0).cast("long")


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes (x, y, w, h); a negative size is no area."""
    over = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    area = lambda z: F.greatest(F.lit(0.0), z["w"]) * F.greatest(F.lit(0.0), z["h"])
    both = over("x", "w") * over("y", "h")
    either = area(a) + area(b) - both
    return F.when((both > 0) & (either > 0), both / either).otherwise(0.0)


def box(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in ("x", "y", "w", "h")}


def half_away(v: Column) -> Column:
    """Rounds halves away from zero, as C's lround does."""
    return (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("long")

"""The tracker's grid of a scene: where tracks are and move, and what that adds to the cost of a match."""

from __future__ import annotations

from math import hypot

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.operators.sequence import with_previous

ROWS, COLS = 6, 8


def cells(boxes: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    x, y = G.foot(*[F.col(c) for c in "xywh"])
    return boxes.withColumn("cell", G.scene_cell(x, y, F.col("width"), F.col("height"), rows, cols))


def moves(boxes: DataFrame, track: str = "det_idx") -> DataFrame:
    """Each box's cell and the cell of the same track's box before."""
    return with_previous(cells(boxes), ["stream_id", track], "frame_id", ["cell"]).filter("prev_cell is not null").withColumnRenamed("prev_cell", "from_cell")


def _recent(rows: DataFrame, boxes: DataFrame, by: list[str], decay: float, span: int = 256) -> DataFrame:
    """n, the rows of each key, and recent, what they still count at their stream's last frame: less by decay for each frame since.

    Summed within spans of frames as at a span's end, so that only a row per key and span has to meet the stream's last frame.
    """
    last = boxes.groupBy("stream_id").agg(F.max("frame_id").alias("end"))
    upto = (F.floor(F.col("frame_id") / span) + 1) * span
    local = rows.groupBy(*by, upto.alias("_upto")).agg(F.count("*").alias("_n"), F.sum(F.pow(F.lit(decay), (upto - F.col("frame_id")).cast("double"))).alias("_recent"))
    late = F.col("_recent") * F.pow(F.lit(decay), (F.col("end") - F.col("_upto")).cast("double"))
    return local.join(last, "stream_id").groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(late).alias("recent"))


def _part(of: str, whole: Column) -> Column:
    return F.when(whole > 0, F.col(of) / whole).otherwise(0.0)


def occupancy(boxes: DataFrame, decay: float = 0.92, first: bool = True) -> DataFrame:
    """How much each cell is used: every box in it counts (without first, only moves into it), less by decay for each frame since. A sum of powers by frame number."""
    used = _recent(cells(boxes) if first else moves(boxes), boxes, ["stream_id", "cell"], decay).select("stream_id", "cell", F.col("recent").alias("used"))
    return used.withColumn("share", _part("used", F.max("used").over(Window.partitionBy("stream_id"))))


def transitions(boxes: DataFrame, decay: float = 0.98) -> DataFrame:
    """How often tracks went from one cell to another, what of that still counts, and its share among all ways out of the first."""
    met = _recent(moves(boxes), boxes, ["stream_id", "from_cell", "cell"], decay)
    return met.withColumn("probability", _part("recent", F.sum("recent").over(Window.partitionBy("stream_id", "from_cell"))))


def extra_cost(pairs: DataFrame, rows: int = ROWS, cols: int = COLS, weights: tuple[float, float, float] = (0.65, 0.15, 0.20), weight: float = 0.15, most: float = 0.30) -> DataFrame:
    """Adds grid_cost to (from_cell, cell, share, probability): far cells, rare cells and rare moves cost more, within 0 to most."""
    row, col = (lambda c: F.floor(F.col(c) / cols)), (lambda c: F.col(c) % cols)
    dr, dc = row("cell") - row("from_cell"), col("cell") - col("from_cell")
    far = F.least(F.sqrt((dr * dr + dc * dc).cast("double")) / max(1.0, hypot(rows - 1, cols - 1)), F.lit(1.0))
    raw = weights[0] * far + weights[1] * (1 - F.coalesce("share", F.lit(0.0))) + weights[2] * (1 - F.coalesce("probability", F.lit(0.0)))
    return pairs.withColumn("grid_cost", F.least(F.greatest(weight * raw, F.lit(0.0)), F.lit(most)))

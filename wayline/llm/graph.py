"""Links to components, and groups of rows to blocks, as the near-duplicate operators need them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import giving_back, settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); component is the smallest node that links reach.

    Large-star and small-star steps in turn: every round points nodes at smaller ones, and a chain of n links takes about log n
    rounds. A round's links are checkpointed; the driver sees two numbers a round. No node's neighbours are gathered: the least one
    comes from a partial aggregate, written out, so that the join that hands it out has a shuffle on either side and a node of many
    links is one that Spark's skew join divides.
    """
    now, mark = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()), None
    while (new := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != mark and new[0]:
        mark = new
        both = now.union(now.select("b", "a"))
        least = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").filter("b != m").union(least.select("a", "m"))
        now = settle(small.toDF("a", "b").distinct())
    top = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(top.select("node", F.col("node").alias("component")))


def blocks(members: DataFrame, sizes: DataFrame, unit: str, most: int) -> DataFrame:
    """Deals members (key, group, ...) to blocks: adds part, first and second, the numbers of two parts of its key that are to be compared.

    sizes is (key, size, main, main_size): a key's weight, its heaviest group and that group's weight. A key of weight up to `most`
    is one block. A heavier one is cut by a hash of the column unit into parts of about that weight, those of its main group apart
    from the others; every two parts meet once, in a group of rows of their own, but for two parts of the main group, whose members
    need no comparison among themselves.
    """
    cut = members.join(sizes, "key").withColumn("_whole", F.col("size") <= most)
    cut = cut.withColumn("_others", F.when(F.col("_whole"), 1).otherwise(F.ceil((F.col("size") - F.col("main_size")) / most)).cast("int"))
    cut = cut.withColumn("_mains", F.when(F.col("_whole"), 0).otherwise(F.ceil(F.col("main_size") / most)).cast("int"))
    hashed, is_main = F.xxhash64(F.col(unit)), (F.col("group") == F.col("main")) & ~F.col("_whole")
    part = F.when(is_main, F.col("_others") + F.pmod(hashed, F.greatest("_mains", F.lit(1)))).otherwise(F.pmod(hashed, F.col("_others"))).cast("int")
    cut = cut.withColumn("_part", part).withColumn("_partners", F.when(is_main, F.col("_others")).otherwise(F.col("_others") + F.col("_mains")))
    met = F.transform(F.sequence(F.lit(0), F.col("_partners") - 1), lambda j: F.struct(F.least("_part", j).alias("first"), F.greatest("_part", j).alias("second")))
    return cut.withColumn("_met", F.explode(met)).select(*members.columns, F.col("_part").alias("part"), F.col("_met.first").alias("first"), F.col("_met.second").alias("second"))


def of_one_id(rows: DataFrame, id_: str, value: list[str], classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes (rep) that rows of one id fall into; None if every id has one value only."""
    hashed = F.xxhash64(*value)
    several = settle(rows.groupBy(id_).agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).filter("low < high").select(id_))
    if several.isEmpty():
        return None
    of = rows.join(several, id_).select(id_, *value).distinct().join(classes.select(*value, "rep"), value).select(id_, "rep")
    least = settle(of.groupBy(id_).agg(F.min("rep").alias("a")))
    return of.join(least, id_).filter("a < rep").select("a", F.col("rep").alias("b"))


def map_runs(dealt: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str, arrow: pa.Schema, rows: int = 10_000) -> DataFrame:
    """Runs work on whole groups of equal (key, first, second), as many as make about so many rows, with the rows at which they begin.

    Rows are sorted by these columns and read as a stream. A group of one row needs no work.
    """
    by = ["key", "first", "second"]

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                table, starts = whole(held)
                yield from out(table.slice(0, starts[-1]), starts[:-1])
                held = table.slice(starts[-1]).to_batches()
        if held:
            yield from out(*whole(held))

    def whole(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in by], axis=1)
        return table, np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)[: len(keys)]

    def out(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if table.num_rows > 1 and (made := work(table.combine_chunks(), starts)) is not None and made.num_rows:
            yield from made.cast(arrow).combine_chunks().to_batches()

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(giving_back(grouped), schema)


def map_groups(dealt: DataFrame, work: Callable[[pa.Table], pa.Table | None], schema: str, arrow: pa.Schema) -> DataFrame:
    """Runs work on every group of equal (key, first, second) of more than one row, as map_runs does."""

    def each(table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        ends = np.append(starts[1:], table.num_rows)
        made = [work(table.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 1]
        made = [x for x in made if x is not None and x.num_rows]
        return pa.concat_tables(made) if made else None

    return map_runs(dealt, each, schema, arrow)


def pairs_within(starts: np.ndarray, n: int, largest: int | None = None, chunk: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs a < b of n rows that stand in one group, about `chunk` at a time; groups begin at starts, those of more than `largest` rows are left out."""
    sizes = np.diff(np.append(starts, n))
    after = np.repeat(starts + sizes, sizes) - np.arange(n) - 1
    if largest is not None:
        after[np.repeat(sizes > largest, sizes)] = 0
    upto, row = np.cumsum(after), 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + chunk, side="right")))
        many = after[row:last]
        a = np.repeat(np.arange(row, last), many)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        row = last


def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """A binary column of rows of equal length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that links among n things reach from each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new

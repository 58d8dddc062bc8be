"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by three rounds of random signs and fast Hadamard transforms; the largest coordinate and its sign name its cell
of the polytope. A bucket is named by some cells together, the last of them perhaps by its remainder only, in each of several
tables; multiprobe adds the buckets that swap one cell for its second best. Vectors that share a bucket and a label are compared by
their cosine in double precision.

How many cells name a bucket follows from the number of vectors of a length, so that a bucket holds about LOAD of them at any size; the number of
tables from trials with random pairs of just the least cosine, all but MISSED of which are to share a bucket. Pairs of a higher cosine, which
is all others that count, are missed less. Vectors of up to EXACT dimensions turn too little for that: they stand in all cells of a grid that a link
may reach, and none is missed. Where no number of tables is enough, all vectors of a length and label are compared, in blocks.

Equal vectors are one class and compared once. Of a bucket's pairs only sums leave a task: a vector's number of links, where a pair
counts in the first bucket it shares, and one vector that stands for its part of the bucket, which is enough for the components.

Defined cases: vectors that are null, empty, all zero, or that hold null or non-finite components, and those without label or id,
link with nothing and are their own component; vectors of different lengths don't link; equal rows count as one vector; rows that
repeat an id with another value or label have one component together, and each has the links of its own value, where another value
of the same id counts as another vector; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.bytetext import mixed
from wayline.llm.common import settle
from wayline.llm.graph import blocks, components, map_runs, matrix, of_one_id, pairs_within, roots

#: Vectors of a bucket, and share of pairs of the least cosine that no table may bring together.
LOAD, MISSED = 4, 0.002
#: Up to so many dimensions a grid finds all pairs; below TRIED the number of tables is tried.
EXACT, TRIED = 4, 48
#: Rows of a bucket that are compared at once; buckets up to SMALL are compared many together.
MOST_OF_BLOCK, SMALL = 1024, 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


@dataclass(frozen=True)
class Hashing:
    """Cells that name a bucket, how many remainders the last of them is told by (0: all its cells), and tables."""

    cells: int
    remainders: int
    tables: int


def _width(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def trial_pairs(dim: int, least: float, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of just the least cosine."""
    rng = np.random.default_rng(31)
    x, y = rng.normal(size=(2, many, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y *= np.sqrt(1 - least * least) / np.linalg.norm(y, axis=1, keepdims=True)
    return x, least * x + y


def met(how: Hashing, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which tables bring a pair together: (pairs, tables)."""
    a, b = buckets(x, how), buckets(y, how)
    return (a[:, :, :, None] == b[:, :, None, :]).any((2, 3))


@cache
def hashing(n: int, dim: int, least: float, most_tables: int = 96) -> Hashing | None:
    """The hashing for n vectors: as many buckets as make LOAD vectors each, and tables enough that all but MISSED of the pairs of the least cosine meet.

    How often one table brings a pair together is measured over a few tables and many pairs; tables are independent, which gives their number. Below TRIED dimensions a
    turn has few ways to go, so that number is tried too, and raised. None if most_tables are too few: then all vectors are to be compared.
    """
    wanted, each = max(2.0, n / LOAD), 2 * _width(dim)
    full = int(np.log(wanted) / np.log(each))
    rest = int(np.ceil(wanted / each**full))
    shape = (full + (rest > 1), rest if rest > 1 else 0)
    some = met(Hashing(*shape, 4), *trial_pairs(dim, least, 400 if dim >= TRIED else 1500)).mean(0)
    chance = min(float(some.mean()) - 2 * float(some.std()) / 2, 1 - 1e-9)
    if chance <= 0:
        return None
    tables = max(1, int(np.ceil(np.log(MISSED) / np.log(1 - chance))))
    while dim < TRIED and tables <= most_tables and met(Hashing(*shape, tables), *trial_pairs(dim, least, 3000)).any(1).mean() < 1 - MISSED:
        tables = int(np.ceil(1.3 * tables)) + 1
    return Hashing(*shape, tables) if tables <= most_tables else None


def near_cells(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors of few dimensions: rows, and the cells of a grid as wide as a link is long that lie within a link of them; each row's own cell comes first.

    Of two vectors that link, each has the other's own cell, so none is missed.
    """
    reach = np.sqrt(2 - 2 * least) * (1 + 1e-9) + 1e-9
    n, dim = x.shape
    own = np.floor(x / reach)
    steps = np.array(sorted(itertools.product((-1, 0, 1), repeat=dim), key=lambda s: any(s)))
    off = np.stack([x - own * reach, np.zeros_like(x), (own + 1) * reach - x])  # to the cell below, this one, the one above
    far = np.zeros((n, len(steps)))
    for d in range(dim):
        far += off[:, :, d].T[:, steps[:, d] + 1] ** 2
    rows, step = np.nonzero(far <= reach * reach)
    cells = own[rows].astype(np.int64) + steps[step]
    key = np.zeros(len(rows), np.int64)
    for d in range(dim):
        key = key * 1_000_003 + cells[:, d]
    return rows, key


def buckets(x: np.ndarray, how: Hashing) -> np.ndarray:
    """Bucket numbers of each row, (rows, tables, 1 + cells): its own, then those with one cell swapped for its second best."""
    n, dim = x.shape
    width = _width(dim)
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - dim)))
    rng = np.random.default_rng(29)
    out = np.zeros((n, how.tables, 1 + how.cells), np.int64)
    rows = np.arange(n)
    for t in range(how.tables):
        cells = []
        for k in range(how.cells):
            y = x
            for signs in rng.choice([-1.0, 1.0], (3, width)):
                y = hadamard(y * signs)
            size = np.abs(y)
            best = size.argmax(1)
            size[rows, best] = -1
            second = size.argmax(1)
            named = [2 * c + (y[rows, c] < 0) for c in (best, second)]
            cells.append([c % how.remainders for c in named] if how.remainders and k == how.cells - 1 else named)
        for probe in range(1 + how.cells):
            key = np.full(n, t, np.int64)
            for k in range(how.cells):
                key = key * (2 * width) + cells[k][1 if probe == k + 1 else 0]
            out[:, t, probe] = key
    return out


def close_pairs(x: np.ndarray, starts: np.ndarray, least: float, chunk: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Rows a < b of one group whose cosine is least or more; groups of rows begin at starts, rows have length 1."""
    sizes = np.diff(np.append(starts, len(x)))
    found = []
    for at in np.flatnonzero(sizes > SMALL):
        some = slice(starts[at], starts[at] + sizes[at])
        a, b = np.nonzero(np.triu(x[some] @ x[some].T >= least, 1))
        found.append(np.stack([a, b]) + starts[at])
    for a, b in pairs_within(starts, len(x), SMALL, chunk):
        yes = np.einsum("ij,ij->i", x[a], x[b]) >= least
        found.append(np.stack([a[yes], b[yes]]))
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return a, b


def linked(table: pa.Table, starts: np.ndarray, least: float, hows: dict[int, Hashing | None]) -> pa.Table | None:
    """The links of some groups: per vector the links that count here, and the vector that stands for its part of the group."""
    width = np.array([len(v) for v in table.column("vector").to_pylist()])
    node, rep, copies, key, part, first, second = (table.column(c).to_numpy() for c in ("node", "rep", "copies", "key", "part", "first", "second"))
    here, none, pairs = np.zeros(len(node), np.int64), np.iinfo(np.int64).max, []
    for size in np.unique(width):
        some = np.flatnonzero(width == size)
        x = matrix(table.column("vector").take(pa.array(some)), "<f8")
        group = np.searchsorted(starts, some, side="right")
        a, b = close_pairs(x, np.flatnonzero(np.diff(group, prepend=-1)), least)
        u, v = some[a], some[b]
        keep = (node[u] != node[v]) & ((first[u] == second[u]) | (part[u] != part[v]))
        a, b, u, v = a[keep], b[keep], u[keep], v[keep]
        pairs.append(np.stack([u, v]))
        keys, how = matrix(table.column("keys").take(pa.array(some)), "<i8"), hows[int(size) // 8]
        probes = 1 + how.cells if how else 1
        for at in range(0, len(a), 20_000):
            p, q = a[at : at + 20_000], b[at : at + 20_000]
            if how is None:
                # both vectors have both own cells
                least_key = np.minimum(keys[p, 0], keys[q, 0])
            else:
                least_key = np.full(len(p), none)
                for t in range(0, keys.shape[1], probes):
                    k, m = keys[p, t : t + probes], keys[q, t : t + probes]
                    least_key = np.minimum(least_key, np.where(k[:, :, None] == m[:, None, :], k[:, :, None], none).min((1, 2)))
            own = least_key == key[some[p]]
            np.add.at(here, some[p[own]], copies[some[q[own]]])
            np.add.at(here, some[q[own]], copies[some[p[own]]])
    a, b = np.concatenate(pairs, axis=1)
    if not len(a):
        return None
    root = roots(len(node), a, b)
    some = np.flatnonzero((here > 0) | (root != np.arange(len(root))))
    return pa.table({"node": node[some], "links": here[some], "a": rep[some], "b": rep[root[some]]})


LINKED = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label"))
    wrong = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~wrong & F.exists("embedding", lambda v: v != 0), F.lit(False))
    values = rows.filter(good).select("vec_id", "label", "embedding")
    classes = settle(values.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    # a row for each length that vectors have
    hows = {r.dim: None if r.dim <= EXACT else hashing(r.n, r.dim, least) for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}

    def keys_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, bucket keys) of unit vectors of one length, and for each the keys by which a pair's first common bucket is told."""
        dim, n = x.shape[1], len(x)
        if dim <= EXACT:
            at, key = near_cells(x, least)
            begins = np.flatnonzero(np.diff(at, prepend=-1))
            return at, key, key[begins][:, None]
        how = hows[dim]
        if how is None:
            return np.arange(n), np.zeros(n, np.int64), np.zeros((n, 1), np.int64)
        keys = buckets(x, how).reshape(n, -1)
        return np.repeat(np.arange(n), keys.shape[1]), keys.ravel(), keys

    def coded(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            begin = np.append(0, np.cumsum(sizes))
            data, told, found = ([None] * len(sizes) for _ in range(3))
            salt = mixed(batch.column("label").to_numpy().view(np.uint64) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for width in np.unique(sizes):
                some = np.flatnonzero(sizes == width)
                x = flat[begin[some][:, None] + np.arange(width)]
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                at, key, names = keys_of(x)
                key = mixed(key.view(np.uint64) ^ salt[some[at]]).view(np.int64)
                names = mixed(names.view(np.uint64) ^ salt[some][:, None]).view(np.int64)
                for i, row, name, mine in zip(some, x, names, np.split(key, np.flatnonzero(np.diff(at)) + 1), strict=True):
                    data[i], told[i], found[i] = row.astype("<f8").tobytes(), name.tobytes(), mine
            ends = np.append(0, np.cumsum([len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("rep"), batch.column("copies"), pa.array(data, pa.binary()), pa.array(told, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))],
                names=["node", "rep", "copies", "vector", "keys", "in_buckets"],
            )

    labelled = classes.withColumn("label", F.xxhash64("label")).select("node", "rep", "copies", "embedding", "label")
    codes = settle(labelled.mapInArrow(coded, "node bigint, rep bigint, copies bigint, vector binary, keys binary, in_buckets array<bigint>"))
    members = codes.select(F.explode(F.array_distinct("in_buckets")).alias("key"), "node", F.lit(0).alias("group"))
    # no group is known to be linked among itself, so a large bucket's parts all meet
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").withColumns({"main": F.lit(1), "main_size": F.lit(0)})
    dealt = blocks(members, sizes, "node", MOST_OF_BLOCK).join(codes.select("node", "rep", "copies", "vector", "keys"), "node")
    found = settle(map_runs(dealt, lambda t, starts: linked(t, starts, least, hows), "node bigint, links bigint, a bigint, b bigint", LINKED))
    joined_up, shared = found.filter("a != b").select("a", "b"), of_one_id(values, "vec_id", ["label", "embedding"], classes)
    parts = components(joined_up if shared is None else joined_up.union(shared))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = classes.join(counted, "node", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return values.join(per_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id").union(alone)

"""Centroid clustering by ball k-means, in whole numbers.

A vector's components become integers floor(SCALE * x), so that distances and means are exact. The centroids start as the vectors whose
ids have the least hashes. A round gives every vector to its nearest centroid and moves each centroid to its vectors' floored mean.

A cluster is a ball about its moved centroid; the radius is that of its farthest member. Only centroids no farther than two radii are
neighbours of the ball. A member nearer to its centroid than half way to the nearest neighbour is in the stable core and stays without a
comparison. The others stand in annuli between the half ways to one neighbour and the next, and are compared with the neighbours inside
their annulus only. A ball that didn't move, nor any other, keeps all members. These tests are on squared whole numbers, so they are
exact, ties included. Balls are of a batch of rows: smaller radii, and no pass over the data to find them.

A round reads the vectors with their clusters and writes them with their new ones; per task it adds one row for each cluster: its members' sums
and count. The next centroids, k rows, come from these rows alone: the other columns of the table aren't read for them.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out; integers are held within a
bound that keeps squared distances within 62 bits (2**26 at 64 dimensions); vectors without id hash as the empty text; repeated rows each count, and
of equal hashes the lesser vector comes first; fewer vectors than clusters make a cluster of each; an empty table gives an empty result;
sums of distances beyond 63 bits are held at the largest long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import shared_folder

SCALE = 256
#: Rows of vectors that are compared at once.
ROWS = 8192
STATE = "vec_id bigint, vector array<int>, cluster int, distance bigint, members bigint, sums array<bigint>"
_ARROW = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("members", pa.int64()), ("sums", pa.list_(pa.int64()))])


def largest(dim: int) -> int:
    """The bound of a component: four times the squared distance of any two vectors stays below 2**63."""
    return int(np.sqrt(2.0**60 / dim) / 2)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered rows x to rows c, as int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # then no sum of products leaves what a double holds exactly
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, one in enumerate(c):
        d = x - one
        out[:, j] = (d * d).sum(1)
    return out


@dataclass(frozen=True)
class Balls:
    """Centroids, their order by distance from each of them, and which of them moved in the last round (None: there was none)."""

    centroids: np.ndarray
    between: np.ndarray
    order: np.ndarray
    moved: bool

    @classmethod
    def of(cls, centroids: np.ndarray, moved: bool = True) -> Balls:
        between = squared(centroids, centroids)
        np.fill_diagonal(between, -1)
        order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        return cls(centroids, np.take_along_axis(between, order, 1), order, moved)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, the smaller number of equals, and its squared distance."""
        d = squared(x, self.centroids)
        best = d.argmin(1)
        return best, d[np.arange(len(x)), best]

    def again(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """As first, from the clusters that rows are in, with the number of distances computed."""
        d = x - self.centroids[cluster]
        own = (d * d).sum(1)
        best, distance, done = cluster.copy(), own.copy(), len(x)
        if not self.moved or len(self.centroids) == 1:
            return best, distance, done
        for i in np.unique(cluster):
            members = np.flatnonzero(cluster == i)
            # neighbours inside a member's annulus: those whose half way is no farther than the member
            annulus = np.searchsorted(self.between[i], 4 * own[members], side="right")
            for reach in np.unique(annulus[annulus > 0]):
                some, near = members[annulus == reach], self.order[i, :reach]
                to = squared(x[some], self.centroids[near])
                done += to.size
                least = to.min(1)
                number = np.where(to == least[:, None], near, len(self.centroids)).min(1)
                better = (least < own[some]) | ((least == own[some]) & (number < i))
                best[some[better]], distance[some[better]] = number[better], least[better]
        return best, distance, done


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy().reshape(-1, dim).astype(np.int64)


def integers(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, vector): the vectors with dim finite components as whole numbers."""
    most = float(largest(dim))
    given = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = (F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(most)), F.lit(-most))).cast("int"))
    return given.filter(F.coalesce(good, F.lit(False))).select("vec_id", held.alias("vector"))


def seeds(whole: DataFrame, k: int, salt: str, dim: int) -> np.ndarray:
    """The k vectors of least hash: a top-k, so the driver gets k rows."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    got = whole.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return np.array([r.vector for r in got], np.int64).reshape(-1, dim)


def assigned(state: DataFrame, balls: Balls, dim: int, keep: bool = True) -> DataFrame:
    """The rows with their new clusters and distances, and each task's sums of its clusters; keep: with the vectors, for another round."""
    sent, again = state.sparkSession.sparkContext.broadcast(balls), "cluster" in state.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = sent.value
        k = len(balls.centroids)
        members, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), [0] * k
        for given in batches:
            for at in range(0, given.num_rows, ROWS):
                batch = given.slice(at, ROWS)
                x = _rows(batch, dim)
                cluster, distance = balls.again(x, batch.column("cluster").to_numpy())[:2] if again else balls.first(x)
                here = np.bincount(cluster, minlength=k)
                order, full = np.argsort(cluster, kind="stable"), np.flatnonzero(here)
                members += here
                sums[full] += np.add.reduceat(x[order], (np.cumsum(here) - here)[full])
                for i, d in zip(full.tolist(), np.split(distance[order], np.cumsum(here[full])[:-1]), strict=True):
                    inertia[i] += sum(d.tolist())
                n = batch.num_rows
                nulls = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector") if keep else pa.nulls(n, pa.list_(pa.int32())), pa.array(cluster, pa.int32()), pa.array(distance), nulls, pa.nulls(n, pa.list_(pa.int64()))], schema=_ARROW)
        full = np.flatnonzero(members)
        if len(full):
            n, long = len(full), np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(full, pa.int32()), pa.array([min(inertia[i], long) for i in full], pa.int64()), pa.array(members[full]), pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(sums[full].ravel()))],
                schema=_ARROW,
            )

    return state.select(*(["vec_id", "vector", "cluster"] if again else ["vec_id", "vector"])).mapInArrow(work, STATE)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters that have members; the others stay. Reads the tasks' sums only; the driver gets k x dim numbers."""
    parts = table.filter("members is not null")
    sums = parts.select("cluster", "members", F.posexplode("sums").alias("place", "value")).groupBy("cluster", "place").agg(F.sum("value").alias("value"), F.sum("members").alias("members"))
    new = centroids.copy()
    for r in sums.collect():
        new[r.cluster, r.place] = r.value // r.members
    return new


@dataclass(frozen=True)
class Clusters:
    """rows: (vec_id, cluster, distance) of every vector; sums: (cluster, members, inertia); the final centroids."""

    rows: DataFrame
    sums: DataFrame
    centroids: np.ndarray


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2") -> Clusters | None:
    """Clusters (vec_id, embedding) by k centroids in so many rounds and a last assignment; None if no vector is kept.

    Centroids are broadcast: k x dim numbers, parameters both, and k x k distances. A round's table is written to the shared folder, so that a lost executor
    costs its tasks of one round.
    """
    spark = vectors.sparkSession
    state = integers(vectors, dim)
    centroids = seeds(state, k, salt, dim)
    if not len(centroids):
        return None
    changed = True
    for turn in range(rounds + 1):
        last = turn == rounds
        folder = shared_folder(spark, "clusters")
        assigned(state, Balls.of(centroids, changed), dim, keep=not last).write.parquet(folder)
        state = spark.read.schema(STATE).parquet(folder)
        if not last:
            new = moved(state, centroids)
            changed, centroids = not np.array_equal(new, centroids), new
            state = state.filter("members is null").select("vec_id", "vector", "cluster")
    long = F.lit(np.iinfo(np.int64).max).cast("decimal(38,0)")
    sums = state.filter("members is not null").groupBy("cluster").agg(F.sum("members").alias("members"), F.least(F.sum(F.col("distance").cast("decimal(38,0)")), long).cast("bigint").alias("inertia"))
    return Clusters(state.filter("members is null").select("vec_id", "cluster", "distance"), sums, centroids)


def digest(spark: SparkSession, found: Clusters | None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector; k rows are broadcast."""
    if found is None:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    each = {r.cluster: r.inertia for r in found.sums.collect()}
    whole = min(sum(each.values()), int(np.iinfo(np.int64).max))
    facts = [(i, n, whole, hashlib.sha256(",".join(map(str, found.centroids[i].tolist())).encode()).hexdigest()) for i, n in sorted(each.items())]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

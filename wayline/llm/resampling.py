"""Importance resampling towards a target distribution, over hashed word n-grams.

Each text's features go to buckets by crc32. A pass writes them once, as packed 16-bit bucket streams: a block of documents is one
row with its stream and the places where each document's part ends. Counts come from those streams: a task sorts a block's stream, run-length
encodes it and keeps the runs' sums. A bucket's gain is the log ratio of its smoothed share in the target and in the corpus. The last pass over the streams
gathers gains and sums them by document with np.add.reduceat; words are cut and hashed only once.

A document's score is its floored mean gain with Gumbel noise from its id, so that the highest scores are a draw without replacement.
The draw's least score is found from counts of scores, first in coarse steps, then within one; only what reaches it is sorted, over
as many tasks as Spark gives, and numbered by the sizes of the sorted parts.

Defined cases: null, empty and wordless texts have no features and weight 0; very long texts are read whole, some MB at a time; rows
without id hash as the empty id, and come before others of equal score; repeated rows are drawn each for itself; an empty table gives an empty result, an empty target has
equal shares; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.bytetext import LOWER, WORD_BYTE, slices
from wayline.llm.common import settle, shared_folder, small_batches

BUCKETS = 10_000
#: Distinct features whose bucket a task remembers, and bytes of a text that are cut into words at once.
REMEMBERED, PIECE = 1 << 17, 1 << 22
_LINE = bytes(int(LOWER[b]) if WORD_BYTE[b] else 32 for b in range(256))
STREAMS = "doc_ids array<bigint>, ends array<bigint>, stream binary"


class Buckets(dict):
    """Bucket of a word, remembered for the words that keep coming."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        at = zlib.crc32(word) % self.n
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) < 64:
            self[word] = at
        return at


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of about PIECE bytes at a time."""
    at, end = 0, len(text)
    while at < end:
        to = min(end, at + PIECE)
        line = text[at:to].translate(_LINE)
        while to < end and b" " not in line:
            to = min(end, 2 * to - at)
            line = text[at:to].translate(_LINE)
        if to < end:
            line = line[: line.rindex(b" ") + 1]
        yield line.split()
        at += len(line)


def stream_of(text: bytes, buckets: Buckets, longest: int) -> np.ndarray:
    """Buckets of all runs of 1 to `longest` words of a text, repeats included."""
    parts, before = [], []
    for words in words_of(text):
        parts.append(np.fromiter(map(buckets.__getitem__, words), np.uint16, len(words)))
        if longest > 1:
            line = before + words
            for n in range(2, longest + 1):
                # runs that end among the new words
                first = max(0, len(before) - n + 1)
                runs = [zlib.crc32(b" ".join(line[k : k + n])) % buckets.n for k in range(first, len(line) - n + 1)]
                parts.append(np.array(runs, np.uint16))
            before = line[len(line) - longest + 1 :] if len(line) >= longest - 1 else line
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_streams(docs: DataFrame, id_: str, folder: str, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """Writes the bucket streams of all texts to the folder, a row per block of about 1 MB of text, and reads them."""
    if buckets > 1 << 16:
        raise ValueError("a bucket takes 16 bits")
    spark = docs.sparkSession
    small_batches(spark)

    def streams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in slices(batches):
            parts = [stream_of(t or b"", known, longest) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ends = np.cumsum([len(p) for p in parts])
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([np.concatenate(parts).astype("<u2").tobytes()], pa.binary())],
                names=["doc_ids", "ends", "stream"],
            )

    given = docs.select(F.col(id_).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    given.mapInArrow(streams, STREAMS).write.parquet(folder)
    return spark.read.schema(STREAMS).parquet(folder)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sorted stream and how often each comes."""
    begins = np.flatnonzero(np.diff(stream, prepend=-1))
    return stream[begins], np.diff(np.append(begins, len(stream)))


def counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket comes in all streams. Tasks send a row for each bucket they met, the driver gets `buckets` sums."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column("stream"):
                value, n = run_lengths(np.sort(np.frombuffer(data.as_py(), "<u2")).astype(np.int64))
                total[value] += n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares in thousandths, floored."""
    n = len(corpus)
    return np.floor(1000 * np.log((target + 1.0) * (float(corpus.sum()) + n) / ((corpus + 1.0) * (float(target.sum()) + n)))).astype(np.int64)


def weights(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of every document: the floored mean gain of its features."""
    sent = streams.sparkSession.sparkContext.broadcast(gain)

    def weighed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for ids, ends, data in zip(*(batch.column(c) for c in ("doc_ids", "ends", "stream")), strict=True):
                at, stream = ends.values.to_numpy(), np.frombuffer(data.as_py(), "<u2")
                size = np.diff(at, prepend=0)
                full = np.flatnonzero(size)
                weight = np.zeros(len(size), np.int64)
                if len(full):
                    weight[full] = np.add.reduceat(gain[stream], (at - size)[full]) // size[full]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(size, pa.int64()), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return streams.mapInArrow(weighed, "doc_id bigint, n_features bigint, weight bigint")


def noise(seed: str, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def least_drawn(scores: DataFrame, most: int, step: int = 512) -> int | None:
    """The highest score that at least `most` rows reach, or None if there are fewer or most is 0.

    Scores are logs in thousandths of numbers that a double holds, so there are some hundreds of steps, and `step` scores in one.
    """

    def reached(counted: dict[int, int], before: int) -> tuple[int | None, int]:
        for at in sorted(counted, reverse=True):
            if before + counted[at] >= most:
                return at, before
            before += counted[at]
        return None, before

    by = F.floor(F.col("score") / step)
    coarse, before = reached({r.at: r.n for r in scores.groupBy(by.alias("at")).agg(F.count("*").alias("n")).collect()}, 0)
    if coarse is None or most <= 0:
        return None
    fine = scores.filter(by == coarse).groupBy("score").agg(F.count("*").alias("n")).collect()
    return reached({r.score: r.n for r in fine}, before)[0]


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """Adds rank, 1, 2, 3 ... by falling score, then doc_id, to the first `most` rows; null beyond.

    The rows are sorted over ranges and numbered by the sizes of the ranges; the place where a row was made parts rows that are equal in all else.
    """
    placed = rows.withColumn("_made", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("_made")]
    done = settle(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_made").withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    # one row a task: numbers of tasks, not of rows
    sizes = done.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = done.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    rank = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return met.select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, longest: int = 1, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn. target: a table with a text."""
    spark = docs.sparkSession
    streams = write_streams(docs, "doc_id", shared_folder(spark, "streams"), buckets, longest)
    wanted = write_streams(target.withColumn("_none", F.lit(None).cast("bigint")), "_none", shared_folder(spark, "target"), buckets, longest)
    weighed = weights(streams, gains(counts(streams, buckets), counts(wanted, buckets)))
    scored = settle(weighed.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))))
    # a text of n words has n runs of one, n - 1 of two, and so on
    features = sum(max(0, least_words - n) for n in range(longest))
    enough = F.col("n_features") >= features
    most = percent * scored.filter(enough).count() // 100
    least = least_drawn(scored.filter(enough), most)
    none = F.lit(None).cast("bigint")
    if least is None:
        return scored.withColumn("rank", none)
    high = enough & (F.col("score") >= least)
    return ranked(scored.filter(high), most).union(scored.filter(~high).withColumn("rank", none))

"""Quality classifier by positive-unlabelled learning.

Trusted positives are all labelled documents of high quality; unlabelled web text is all documents that may be learned from. Their measures are
computed once and stored in blocks; each step of the fit is a pass of tasks over all blocks, which sums the slopes of all documents, so that
every document and every label counts alike, whatever the corpus. A small
network over measures of a text's shape minimises the non-negative unbiased risk (logistic loss): the positives' share of the
unlabelled loss, weighed by the class prior, is taken out, and where what remains for negatives falls below zero the step is
reversed. The class prior is estimated from how the scores of a first, positive-against-unlabelled fit distribute: that fit sees one half of the
positives, by a hash of their ids, and the scores of the other half are counted against those of all documents.

Defined cases: null or empty text, and text without words, has all measures 0 and is scored like any other; very long texts are
measured whole; without positives or unlabelled rows all scores are 0.5; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.bytetext import joined, slices, word_hashes
from wayline.llm.common import settle, small_batches

#: Documents that stand for a cell of the summary.
KEPT = 8
#: Rows of a block of measures, and of a task of a pass.
BLOCK, TASK_ROWS = 4096, 100_000
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (9, 11, 12, 13, 32), "line": (10,), "stop": b".,;:?'\"-", "shout": b"!", "bar": b"|", "far": range(128, 256)}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _k
_KINDS = len(_CLASSES) + 1
MEASURES = 15
_SOME = pa.list_(pa.struct([("hash", pa.int64()), ("x", pa.list_(pa.float64()))]))


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of MEASURES numbers per text: shares of kinds of bytes, word length, repetition."""
    n = len(offsets) - 1
    counts = np.zeros((n, _KINDS))
    kinds, full = _CLASS[data], np.flatnonzero(np.diff(offsets))
    for k in range(_KINDS):
        if len(full):
            counts[full, k] = np.add.reduceat(kinds == k, offsets[full], dtype=np.int64)
    h, bounds = word_hashes(data, offsets)
    words = np.diff(bounds)
    text = np.repeat(np.arange(n), words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    again = np.bincount(text[same], minlength=n)
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    letters = counts[:, 0] + counts[:, 1] + counts[:, 8]
    per = lambda x, y: x / np.maximum(y, 1)
    size = np.diff(offsets)
    return np.stack(
        [np.log1p(words), per(counts[:, 0], letters), per(counts[:, 2], size), per(counts[:, 3], words), per(counts[:, 4], words), per(counts[:, 5], words), per(counts[:, 6], words), per(counts[:, 7], words),
         per(counts[:, 8], size), per(counts[:, 9], words), per(letters, words) / 10, per(distinct, words), per(again, words), per(distinct, np.sqrt(words)) / 10, (words == 0).astype(float)], axis=1
    )


@dataclass(frozen=True)
class Network:
    """One hidden layer of tanh units over standardised measures."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b) @ self.v + self.c


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def outputs(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hidden units of each row and its output."""
    a = np.tanh(x @ w[0] + w[1])
    return a, a @ w[2] + w[3]


def back(w: list[np.ndarray], x: np.ndarray, a: np.ndarray, d: np.ndarray, decay: float) -> list[np.ndarray]:
    """The slopes of the loss in the weights from those in the outputs, d; decay pulls the weights to 0."""
    da = np.outer(d, w[2]) * (1 - a * a)
    return [x.T @ da + decay * w[0], da.sum(0), a.T @ d + decay * w[2], d.sum(keepdims=True)]


def risk_parts(negative: float, prior: float) -> tuple[float, float, float]:
    """What a step of the non-negative risk takes of three slopes in the outputs: of positives by their sigmoid, of positives by 1, of unlabelled rows by their sigmoid.

    negative is the negatives' share of the risk; while it is below 0 the step goes back up on that share alone.
    """
    return (prior, 0.0, -1.0) if negative < 0 else (0.0, -prior, 1.0)


def risk_slope(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The step of the non-negative risk in the outputs of positives and of unlabelled rows, one by one; the fit's passes give its sums.

    The negatives' share of the risk is what unlabelled rows cost as negatives less what the prior's share of positives among them
    costs so.
    """
    by_sigmoid, by_one, unlabelled = risk_parts(np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp)), prior)
    return (by_sigmoid * _sigmoid(gp) + by_one) / len(gp), unlabelled * _sigmoid(gu) / len(gu)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, caution: float = 0.96) -> float:
    """A share of positives that the unlabelled scores can't contradict: above any score, they hold at least prior times the positives' share.

    Both are counts of documents by ascending bins of scores. The lower end of what the counts tell, and less by caution: a prior that is
    too high makes the risk of the unlabelled negatives vanish while they still score high, one that is a little too low only shifts the
    positives' scores.
    """
    from_here = lambda n: np.cumsum(n[::-1])[::-1] / n.sum()
    above, wanted = from_here(unlabelled), from_here(positive)
    cuts = np.searchsorted(-wanted, np.linspace(0.02, 0.6, 15) - 1, side="right") - 1
    sure = above - np.sqrt(above * (1 - above) / unlabelled.sum())
    return float(np.clip(caution * np.min(sure[cuts] / wanted[cuts]), 0.05, 0.98))


#: A block's rows: who is a positive of the first or the second half (1, 2; else 0), and the measures.
_POINTS = "kind binary, x binary"
#: Bins of a score: logits from -16 to 16 by 1/256.
_BINS, _BIN = 8192, 256


def points(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """The measures of all documents that `allowed` admits, in blocks, with those labelled as good told apart; labels meet measures, no text is shuffled."""

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = measures(*joined(batch.column("text")))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, MEASURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], names=["doc_id", "x"])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rows, n = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(kinds)], pa.binary()), pa.array([b"".join(rows)], pa.binary())], names=["kind", "x"])

        for batch in batches:
            kinds.append(batch.column("kind").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
            rows.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).tobytes())
            n += batch.num_rows
            if n >= BLOCK:
                yield block()
                kinds, rows, n = [], [], 0
        if n:
            yield block()

    small_batches(docs.sparkSession)
    good = labels.filter(allowed & (F.col("quality") == 1)).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("good", F.lit(1))
    x = docs.filter(allowed).selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(measured, "doc_id bigint, x array<double>")
    kind = F.when(F.col("good").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(2)) + 1).cast("int").alias("kind")
    return settle(x.join(good, "doc_id", "left").select(kind, "x").mapInArrow(packed, _POINTS))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The kinds and measures of each block."""
    for batch in batches:
        for kind, x in zip(batch.column("kind"), batch.column("x"), strict=True):
            yield np.frombuffer(kind.as_buffer(), np.uint8), np.frombuffer(x.as_buffer()).reshape(-1, MEASURES)


def _total(blocks: DataFrame, work) -> np.ndarray:
    """The sum over all blocks of what work(kind, x) gives for each, an array of one length; a task sends its sum."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(itertools.starmap(work, _read(batches)))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], names=["sums"])

    return sum(np.frombuffer(r.sums) for r in blocks.mapInArrow(summed, "sums binary").collect())


def _flat(w: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w])


@dataclass(frozen=True)
class Standard:
    """The mean and standard deviation by which measures are standardised."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)


def slopes(blocks: DataFrame, w: list[np.ndarray], standard: Standard, kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Sums over all documents: the slopes in the weights of positives of these kinds by their sigmoid and by 1, and of all documents by their sigmoid; the costs of those positives and of all documents as negatives."""

    def work(kind: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = standard(x)
        a, g = outputs(w, z)
        some = np.isin(kind, kinds)
        p, ap, gp = z[some], a[some], g[some]
        parts = back(w, p, ap, _sigmoid(gp), 0.0), back(w, p, ap, np.ones(len(gp)), 0.0), back(w, z, a, _sigmoid(g), 0.0)
        return np.concatenate([*map(_flat, parts), [np.logaddexp(0, gp).sum(), np.logaddexp(0, g).sum()]])

    got = _total(blocks, work)
    return *np.split(got[:-2], 3), got[-2], got[-1]


def _descend(blocks: DataFrame, standard: Standard, kinds: tuple[int, ...], n_p: float, n_u: float, parts, hidden: int, steps: int, rate: float = 0.1, decay: float = 1e-3) -> list[np.ndarray]:
    """Adam over all documents: each step is one pass; its rate falls to a hundredth. parts(cost of positives, of all documents) gives what a step takes of the three slopes."""
    rng = np.random.default_rng(11)
    w = [rng.normal(0, 1 / np.sqrt(MEASURES), (MEASURES, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    ends = np.cumsum([x.size for x in w])[:-1]
    m, s = np.zeros(sum(x.size for x in w)), np.zeros(sum(x.size for x in w))
    for t in range(1, steps + 1):
        by_sigmoid, by_one, unlabelled, cost_p, cost_u = slopes(blocks, w, standard, kinds)
        a, b, c = parts(cost_p / n_p, cost_u / n_u)
        grad = (a * by_sigmoid + b * by_one) / n_p + c * unlabelled / n_u + decay * _flat([w[0], 0 * w[1], w[2], 0 * w[3]])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        now = rate * (0.01 + 0.495 * (1 + np.cos(np.pi * (t - 1) / steps)))
        flat = _flat(w) - now * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w = [part.reshape(x.shape) for part, x in zip(np.split(flat, ends), w, strict=True)]
    return w


def score_counts(blocks: DataFrame, w: list[np.ndarray], standard: Standard, kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """How many positives of these kinds, and how many of all documents, stand in each bin of the outputs; tasks count, their counts are summed by bin."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, _BINS), np.int64)
        for kind, x in _read(batches):
            at = np.clip(np.floor(outputs(w, standard(x))[1] * _BIN) + _BINS // 2, 0, _BINS - 1).astype(np.int64)
            n += np.stack([np.bincount(at[np.isin(kind, kinds)], minlength=_BINS), np.bincount(at, minlength=_BINS)])
        some = np.flatnonzero(n[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0, some]), pa.array(n[1, some])], names=["bin", "p", "u"])

    n = np.zeros((2, _BINS))
    for r in blocks.mapInArrow(counted, "bin bigint, p bigint, u bigint").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect():
        n[:, r.bin] = r.p, r.u
    return n[0], n[1]


def fit(blocks: DataFrame, hidden: int = 12, steps: int = 80) -> Network:
    """A network fitted to all documents of all blocks; the driver gets sums only."""
    got = _total(blocks, lambda kind, x: np.concatenate([np.bincount(kind, minlength=3), x.sum(0), (x * x).sum(0)]))
    if not isinstance(got, np.ndarray) or not got[1] + got[2]:
        return Network(np.zeros(MEASURES), np.ones(MEASURES), np.zeros((MEASURES, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 0.5)
    n, n_p = got[:3].sum(), got[1] + got[2]
    mean, square = got[3 : 3 + MEASURES] / n, got[3 + MEASURES :] / n
    standard = Standard(mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3)
    blocks = blocks.coalesce(max(blocks.sparkSession.sparkContext.defaultParallelism, int(n // TASK_ROWS)))
    # of few positives all may be in one half
    halves = ((1,), (2,)) if got[1] and got[2] else ((1, 2), (1, 2))
    first = _descend(blocks, standard, halves[0], got[list(halves[0])].sum(), n, lambda *_: (1.0, -1.0, 1.0), hidden, steps // 2)
    prior = estimate_prior(*score_counts(blocks, first, standard, halves[1]))
    w, b, v, c = _descend(blocks, standard, (1, 2), n_p, n, lambda cost_p, cost_u: risk_parts(cost_u - prior * cost_p, prior), hidden, steps)
    return Network(standard.mean, standard.scale, w, b, v, float(c[0]), prior)


def cells(docs: DataFrame, medians: np.ndarray, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A short summary of documents, from which nothing is learned: the measures of up to `kept` of each cell, how many documents each of these stands for, and the mean and standard deviation of all.

    A cell's documents are those of least hash. Tasks sum and choose by cell before the shuffle; the driver gets at most kept x 2**MEASURES rows.
    """

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in slices(batches):
            x, h = measures(*joined(batch.column("text"))), batch.column("hash").to_numpy()
            cell = (x > medians) @ (1 << np.arange(MEASURES))
            order = np.lexsort((h, cell))
            ends = np.append(np.flatnonzero(np.diff(cell[order])) + 1, len(order))
            for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                some = order[a:b]
                sums = held.setdefault(int(cell[some[0]]), [0, np.zeros(2 * MEASURES), []])
                sums[0] += len(some)
                sums[1] += np.concatenate([x[some].sum(0), (x[some] * x[some]).sum(0)])
                sums[2] = sorted([*sums[2], *((int(h[i]), x[i].tolist()) for i in some[:kept])])[:kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tolist() for v in held.values()], pa.list_(pa.float64())), pa.array([[{"hash": h, "x": x} for h, x in v[2]] for v in held.values()], _SOME)],
            names=["cell", "n", "sums", "some"],
        )

    small_batches(docs.sparkSession)
    given = docs.selectExpr("xxhash64(doc_id, text) as hash", "cast(text as string) as text")
    parts = settle(given.mapInArrow(summed, "cell int, n bigint, sums array<double>, some array<struct<hash: bigint, x: array<double>>>"))
    n = {r.cell: r.n for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    if not n:
        return np.zeros((0, MEASURES)), np.zeros(0), np.zeros(MEASURES), np.ones(MEASURES)
    sums = np.array([r.v for r in parts.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("v")).orderBy("place").collect()])
    best = F.row_number().over(Window.partitionBy("cell").orderBy("s.hash", "s.x"))
    got = parts.select("cell", F.explode("some").alias("s")).withColumn("_n", best).filter(F.col("_n") <= kept).orderBy("cell", "_n").select("cell", "s.x").collect()
    cell = np.array([r.cell for r in got])
    stands = np.array([n[c] for c in cell.tolist()]) / np.bincount(cell)[cell]
    mean, square = sums[:MEASURES] / sum(n.values()), sums[MEASURES:] / sum(n.values())
    return np.array([r.x for r in got], float), stands, mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, **how) -> Network:
    """Fits on all documents labelled as good and on all documents that `allowed` admits; tasks measure and sum, the driver gets sums."""
    return fit(points(docs, labels, allowed), **how)


def score(docs: DataFrame, model: Network) -> DataFrame:
    """(doc_id, score) of every document."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            z = sent.value.logit(measures(*joined(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(z))], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(scored, "doc_id bigint, score double")

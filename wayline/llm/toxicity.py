"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours, and pairs with one word between, each hashed to one of 2**BITS
coordinates. Fitting goes through a bounded sample of labelled rows once per epoch with a learning rate per coordinate; L1 keeps
most coordinates at exactly 0, so the weights that scoring broadcasts are a short list.

Defined cases: null or empty text, and text without words, scores as the bias alone; very long texts are read whole in fit and score; an empty or one-sided set of labels gives the bias of what it has;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from wayline.llm.bytetext import joined, mixed, slices, within, word_hashes
from wayline.llm.common import carrying, giving_back, small_batches, with_text
from wayline.llm.samples import labelled

BITS = 20
#: Bound of the fitting sample: labelled rows, whose texts are read whole.
MOST_ROWS = 12_000
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every word, pair and skip-pair; not distinct."""
    h, bounds = word_hashes(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    pair, skip = within(bounds, 1), within(bounds, 2)
    shift = np.uint64(64 - BITS)
    at = np.concatenate([h, mixed(h[pair] * _PAIR + h[pair + 1]), mixed(h[skip] * _SKIP + h[skip + 2])]) >> shift
    return np.concatenate([text, text[pair], text[skip]]), at.astype(np.int64)


@dataclass(frozen=True)
class Weights:
    """The coordinates that aren't 0, in ascending order, and their weights."""

    at: np.ndarray
    weight: np.ndarray
    bias: float


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 5, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0) -> Weights:
    """FTRL-proximal over rows of distinct coordinates. The last coordinate is the bias, which L1 spares."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        rate = (beta + np.sqrt(n[at])) / alpha + l2
        lasso = np.where(at == size, 0.0, l1)
        return np.where(np.abs(zi) <= lasso, 0.0, (np.sign(zi) * lasso - zi) / rate)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    # a coordinate within the lasso has no weight
    at = np.flatnonzero(np.abs(z[:size]) > l1)
    return Weights(at, weights(at), float(weights(np.array([size]))[0]))


def _featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = joined(batch.column("text"))
        text, at = features(data, offsets)
        key = np.unique((text << BITS) | at)
        ends = np.searchsorted(key >> BITS, np.arange(batch.num_rows + 1))
        rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), rows], names=["doc_id", "label", "at"])


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = MOST_ROWS, **how) -> Weights:
    """Fits on at most `most` labelled rows that `allowed` admits; tasks make their features, the driver gets coordinates only."""
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, "toxic", allowed, most).selectExpr("cast(doc_id as bigint) as doc_id", "label", "text")
    got = sample.mapInArrow(giving_back(_featurise), "doc_id bigint, label int, at array<int>").toArrow()
    order, rows = pc.sort_indices(got, [("doc_id", "ascending"), ("label", "ascending")]).to_numpy(), got.column("at")
    return fit([rows[i].values.to_numpy() for i in order], got.column("label").to_numpy()[order].astype(float), **how)


def score(docs: DataFrame, model: Weights) -> DataFrame:
    """(row, doc_id, score) of every document, row being all its columns; the model's short list of weights is broadcast."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[m.at] = m.weight
        for batch in slices(with_text(batches)):
            data, offsets = joined(batch.column("text"))
            text, at = features(data, offsets)
            known = np.flatnonzero(dense[at])
            key = np.unique((text[known] << BITS) | at[known])
            z = m.bias + np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=["row", "doc_id", "score"])

    given = carrying(docs)
    return given.mapInArrow(giving_back(scored), given.select("row", "doc_id").schema.add("score", "double"))

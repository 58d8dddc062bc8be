"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, each of which the network reads from both ends; at every byte it gives a
probability for every language. A document's probabilities are the mean over all its bytes. The network is trained in numpy by
back-propagation through time on windows, drawn from the whole texts of a bounded sample of documents by the tasks that hold them.

Defined cases: null text and text without any letter is `und` with score 0; very long texts are read whole, window by window, in
bounded memory; languages are those of the sample; without any sample all documents are `und`; repeated rows are labelled alike;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.bytetext import joined, slices
from wayline.llm.common import carrying, giving_back, small_batches, with_text
from wayline.llm.samples import some_rows, texts_of

UND = "und"
HIDDEN, WINDOW, BATCH = 8, 192, 2048
#: Bound of the fitting sample: documents. Of each, so many windows of so many bytes train the network, drawn from all over its text.
MOST_ROWS, DRAWN, LENGTH = 3000, 16, 72


@dataclass
class Network:
    """table: byte to gate inputs, (2, 3 H, 256); inner: state to gates, (2, 3 H, H); out: both states to languages, (L, 2 H)."""

    languages: list[str]
    table: np.ndarray
    inner: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def read_windows(net: Network, windows: np.ndarray) -> np.ndarray:
    """Probabilities of the languages at every byte: windows (T, B) of bytes to (T, L, B)."""
    steps, many = windows.shape
    size = net.inner.shape[2]
    state = np.zeros((2, size, many), np.float32)
    seen = np.empty((steps, 2 * size, many), np.float32)
    x = np.empty((2, 3 * size, many), np.float32)
    gates = np.empty_like(x)
    for t in range(steps):
        np.take(net.table[0], windows[t], axis=1, out=x[0], mode="clip")
        np.take(net.table[1], windows[steps - 1 - t], axis=1, out=x[1], mode="clip")
        np.matmul(net.inner, state, out=gates)
        both = gates[:, : 2 * size]
        both += x[:, : 2 * size]
        both *= 0.5
        np.tanh(both, out=both)
        both *= 0.5
        both += 0.5
        new = gates[:, 2 * size :]
        new *= gates[:, size : 2 * size]
        new += x[:, 2 * size :]
        np.tanh(new, out=new)
        state -= new
        state *= gates[:, :size]
        state += new
        seen[t, :size] = state[0]
        seen[steps - 1 - t, size:] = state[1]
    logits = np.matmul(net.out, seen)
    logits += net.bias[:, None]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def slopes(w: list[np.ndarray], x: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean loss over all bytes of windows x (T, B), whose languages are truth, and its slope in each of a network's arrays, back through time."""
    table, inner, out, bias = w
    (length, many), h, eye = x.shape, inner.shape[2], np.eye(256, dtype=inner.dtype)
    state, kept, seen = np.zeros((2, h, many), inner.dtype), [], np.empty((length, 2 * h, many), inner.dtype)
    for t in range(length):
        a = inner @ state
        xt = np.stack([table[0][:, x[t]], table[1][:, x[length - 1 - t]]])
        zr = _sigmoid(xt[:, : 2 * h] + a[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(xt[:, 2 * h :] + r * a[:, 2 * h :])
        kept.append((state, z, r, n, a[:, 2 * h :]))
        state = n + z * (state - n)
        seen[t, :h], seen[length - 1 - t, h:] = state[0], state[1]
    logits = out @ seen + bias[:, None]
    prob = np.exp(logits - logits.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    loss = -float(np.mean(np.log(prob[:, truth, np.arange(many)])))
    prob[:, truth, np.arange(many)] -= 1
    prob /= many * length
    grads = [np.zeros_like(table), np.zeros_like(inner), np.einsum("tlb,thb->lh", prob, seen), prob.sum((0, 2))]
    back = out.T @ prob
    slope = np.zeros((2, h, many), inner.dtype)
    for t in range(length - 1, -1, -1):
        before, z, r, n, an = kept[t]
        slope = slope + np.stack([back[t, :h], back[length - 1 - t, h:]])
        dn = slope * (1 - z) * (1 - n * n)
        dz, dr = slope * (before - n) * z * (1 - z), dn * an * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], 1)
        dx = np.concatenate([dz, dr, dn], 1)
        grads[1] += da @ before.transpose(0, 2, 1)
        grads[0][0] += dx[0] @ eye[x[t]]
        grads[0][1] += dx[1] @ eye[x[length - 1 - t]]
        slope = slope * z + inner.transpose(0, 2, 1) @ da
    return loss, grads


def train(windows: list[list[bytes]], labels: np.ndarray, languages: list[str], steps: int = 350, many: int = 96, length: int = LENGTH, rate: float = 0.02) -> Network:
    """Adam over the windows of texts; every byte of a window is to be labelled with its text's language."""
    rng = np.random.default_rng(5)
    h, kinds = HIDDEN, len(languages)
    w = [rng.normal(0, 0.4, (2, 3 * h, 256)), rng.normal(0, 0.3, (2, 3 * h, h)), rng.normal(0, 0.3, (kinds, 2 * h)), np.zeros(kinds)]
    w = [x.astype(np.float32) for x in w]
    m, s = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    by_language = [np.flatnonzero(labels == k) for k in range(kinds)]
    for step in range(1, steps + 1):
        truth = rng.integers(kinds, size=many)
        x = np.full((length, many), 32, np.uint8)
        for i, k in enumerate(truth):
            some = windows[rng.choice(by_language[k])]
            part = np.frombuffer(some[rng.integers(len(some))][:length], np.uint8)
            x[: len(part), i] = part
        _, grads = slopes(w, x, truth)
        pace = rate * (1 - step / (steps + 1)) + 1e-3
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            w[k] = (w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(languages, *w)


def drawn(text: bytes, seed: int, many: int = DRAWN, length: int = LENGTH) -> list[bytes]:
    """Windows from anywhere in a text; a text that is no longer than one is its only window."""
    if len(text) <= length:
        return [text] if text else []
    return [text[at : at + length] for at in np.random.default_rng(seed).integers(len(text) - length + 1, size=many).tolist()]


def _draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows = [drawn(t, seed & (2**63 - 1)) for t, seed in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("seed").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(windows, pa.list_(pa.binary()))], names=["doc_id", "lang", "windows"])


def learn(docs: DataFrame, allowed: Column, most: int = MOST_ROWS, **how) -> Network | None:
    """Trains on at most `most` documents with a language that `allowed` admits, chosen by a hash of their ids; the driver gets their windows."""
    small_batches(docs.sparkSession)
    chosen = some_rows(docs.select("doc_id", "lang").filter(allowed & F.col("lang").isNotNull()).distinct(), most, "doc_id", "lang")
    sample = texts_of(docs.filter(allowed & F.col("text").isNotNull()), chosen).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "lang").alias("seed"), "text")
    got = sample.mapInArrow(_draw, "doc_id bigint, lang string, windows array<binary>").toArrow().to_pylist()
    rows = sorted(((r["doc_id"], r["lang"], r["windows"]) for r in got if r["windows"]), key=repr)
    if not rows:
        return None
    languages = sorted({k for _, k, _ in rows})
    return train([w for _, _, w in rows], np.array([languages.index(k) for _, k, _ in rows]), languages, **how)


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: mean probability of each language over its bytes, and number of bytes labelled with each."""
    n, kinds = len(offsets) - 1, len(net.languages)
    total, labelled = np.zeros((n, kinds)), np.zeros((n, kinds), np.int64)
    sizes = np.diff(offsets)
    per_text = -(-sizes // WINDOW)
    text = np.repeat(np.arange(n), per_text)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = offsets[:-1][text] + place * WINDOW
    length = np.minimum(WINDOW, offsets[1:][text] - begin)
    step = np.arange(WINDOW)[:, None]
    for a in range(0, len(text), BATCH):
        some = slice(a, a + BATCH)
        inside = step < length[some]
        windows = np.where(inside, data[np.minimum(begin[some] + step, len(data) - 1)], np.uint8(32))
        prob = read_windows(net, windows)
        best = prob.argmax(1)
        for k in range(kinds):
            np.add.at(total[:, k], text[some], np.einsum("tb,tb->b", prob[:, k], inside))
            np.add.at(labelled[:, k], text[some], ((best == k) & inside).sum(0))
    return total / np.maximum(sizes, 1)[:, None], labelled


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(row, doc_id, lang_pred, score, labelled) of every document; row is all its columns, labelled counts the bytes given to each language, in the network's order."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in slices(with_text(batches)):
            speaks = np.array(batch.column("speaks").to_pylist(), bool)
            if net is None:
                best, score, counts = np.full(len(speaks), UND, object), np.zeros(len(speaks)), np.zeros((len(speaks), 0), np.int64)
            else:
                prob, counts = pooled(net, *joined(batch.column("text")))
                best, score = np.array(net.languages, object)[prob.argmax(1)], np.clip(prob.max(1), 0, 1)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(speaks) + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(np.where(speaks, best, UND).tolist(), pa.string()), pa.array(np.where(speaks, score, 0.0)), rows], names=["row", "doc_id", "lang_pred", "score", "labelled"]
            )

    given = carrying(docs, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("speaks"))
    return given.mapInArrow(giving_back(labels), given.select("row", "doc_id").schema.add("lang_pred", "string").add("score", "double").add("labelled", T.ArrayType(T.LongType())))

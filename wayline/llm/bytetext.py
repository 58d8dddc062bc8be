"""Vectorised views of a batch of texts: numpy over the UTF-8 bytes that Arrow already holds side by side."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Letters, digits and every byte of a character beyond ASCII.
WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def joined(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets at which each begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold at most so many bytes, or that are one longer text: numpy's temporaries stay small."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, side="right")))
            yield batch.slice(at, end - at)
            at = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes, so that every bit depends on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, ASCII letters lower-cased, and the bounds of each text's words among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = word_byte[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    place[~inside] = 0
    # a power of its own for every place in a word, and each product mixed before the sum: no exchange of bytes leaves the sum as it was
    value = LOWER[data].astype(np.uint64)
    value += np.uint64(1)
    value *= np.cumprod(np.full(int(place.max()) + 1, _BASE))[place]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    value[~inside] = 0
    return mixed(np.add.reduceat(value, starts)), bounds


def within(bounds: np.ndarray, reach: int) -> np.ndarray:
    """Indices of words that have reach more words after them in their text."""
    n = int(bounds[-1])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[0], n)
    return np.flatnonzero(left > reach)

"""Token ids in bit-packed files.

An id takes the least number of bits that the vocabulary needs. A file holds blocks of BLOCK ids (the last may be shorter), then the
blocks' offsets, the documents' ids (with a byte each that tells whether it is null) and where each document ends, then a trailer.
A block unpacks with a few numpy calls, and any document is found by one look at the ends and read from its blocks alone.

Documents are dealt to tasks by ranges of doc_id; each task writes one file under a name of its own, and only the files of attempts
that succeeded are in the manifest, so a lost or repeated task leaves no trace in the result.

Defined cases: null text is empty; an empty text has the end id alone; rows that repeat an id stand in order of a hash of their text, null
ids come first; an empty table gives an empty manifest and no rows; very long texts pass through in blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from wayline.llm.bytetext import slices
from wayline.llm.common import shared_folder, small_batches
from wayline.llm.pieces import PLAIN, Remembered, in_symbols, library, plain_pattern, sent

MAGIC, VERSION, BLOCK = b"WIDS", 1, 1 << 16
_TRAILER = struct.Struct("<QQQQII4s")
#: Pieces whose ids a worker remembers from one batch to the next.
REMEMBERED = 200_000
#: Ids that a reader holds at a time, unless one document has more.
READ_AHEAD = 1 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side, each in so many bits, highest bit first: eight ids fill as many bytes as one has bits."""
    groups = np.zeros((8, -(-len(ids) // 8)), np.uint32)
    whole = len(ids) // 8
    groups[:, :whole] = ids[: 8 * whole].reshape(-1, 8).T
    groups[: len(ids) - 8 * whole, whole:] = ids[8 * whole :].reshape(-1, 1)
    out = np.zeros((groups.shape[1], bits), np.uint8)
    for byte in range(bits):
        for k in range(8 * byte // bits, (8 * byte + 7) // bits + 1):
            beyond = (k + 1) * bits - 8 * (byte + 1)
            out[:, byte] |= (groups[k] >> beyond if beyond >= 0 else groups[k] << -beyond).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    raw = np.zeros(-(-count // 8) * bits, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    planes = raw.reshape(-1, bits).T.astype(np.uint32)
    out = np.zeros((8, planes.shape[1]), np.uint32)
    for k in range(8):
        for byte in range(k * bits // 8, ((k + 1) * bits - 1) // 8 + 1):
            beyond = (k + 1) * bits - 8 * (byte + 1)
            out[k] |= planes[byte] << beyond if beyond >= 0 else planes[byte] >> -beyond
    return (out.T.ravel()[:count] & np.uint32((1 << bits) - 1)).astype("<u4")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.waiting, self.waits = stream, bits, [], 0
        self.offsets, self.doc_ids, self.ends, self.n_ids = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.waits += len(ids)
        self.n_ids += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n_ids)
        if self.waits >= BLOCK:
            self._flush(self.waits - self.waits % BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        for at in range(0, count, BLOCK):
            self.offsets.append(self.stream.tell())
            self.stream.write(pack(ids[at : min(at + BLOCK, count)], self.bits))
        self.waiting, self.waits = [ids[count:]], len(ids) - count

    def close(self) -> None:
        if self.waits:
            self._flush(self.waits)
        footer = self.stream.tell()
        for part in (np.array(self.offsets, "<u8"), np.array([x or 0 for x in self.doc_ids], "<i8"), np.array([x is None for x in self.doc_ids], np.uint8), np.array(self.ends, "<u8")):
            self.stream.write(part.tobytes())
        self.stream.write(_TRAILER.pack(footer, len(self.offsets), len(self.doc_ids), self.n_ids, self.bits, VERSION, MAGIC))
        self.stream.close()


class Reader:
    """Random access to a file of ids."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        footer, blocks, docs, self.n_ids, self.bits, version, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"not a file of ids: {uri}")
        data = self.file.read_at(size - _TRAILER.size - footer, footer)
        cuts = np.cumsum([0, 8 * blocks, 8 * docs, docs, 8 * docs])
        self.offsets, ids, null, self.ends = (np.frombuffer(data[a:b], kind) for a, b, kind in zip(cuts, cuts[1:], ("<u8", "<i8", np.uint8, "<u8"), strict=False))
        self.doc_ids = [None if n else i for i, n in zip(ids.tolist(), null.tolist(), strict=True)]

    def between(self, start: int, end: int) -> np.ndarray:
        """Ids from start to end, unpacked from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, (end - 1) // BLOCK
        count = min((last + 1) * BLOCK, self.n_ids) - first * BLOCK
        begin = int(self.offsets[first])
        # BLOCK is a multiple of 8, so blocks end on a byte and neighbours unpack as one
        return unpack(self.file.read_at(-(-count * self.bits // 8), begin), count, self.bits)[start - first * BLOCK : end - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.between(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of all documents in order, unpacked READ_AHEAD ids at a time."""
        k = 0
        while k < len(self.ends):
            start = int(self.ends[k - 1]) if k else 0
            upto = max(k + 1, int(np.searchsorted(self.ends, start + READ_AHEAD, side="right")))
            ids = self.between(start, int(self.ends[upto - 1]))
            for j in range(k, upto):
                a = int(self.ends[j - 1]) if j else 0
                yield self.doc_ids[j], a, ids[a - start : int(self.ends[j]) - start]
            k = upto


class PieceEncoder:
    """The tokenizers library's BPE over the distinct pieces of a batch; texts beyond plain Latin, or with special tokens, go to the library whole."""

    def __init__(self, file_json: str, pattern: str):
        self.library, self.cut = library(file_json), plain_pattern(pattern).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bits = max(1, (self.library.get_vocab_size() - 1).bit_length())
        self.ids: Remembered[str, bytes] = Remembered(REMEMBERED)

    def made(self, pieces: set[str]) -> dict[str, bytes]:
        tokens = self.library.model.tokenize
        return {x: array("I", [t.id for t in tokens(in_symbols(x))]).tobytes() for x in pieces}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        plain = [t is None or PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        cut = [self.cut(t or "") if p else None for t, p in zip(texts, plain, strict=True)]
        ids = self.ids.of({x for pieces in cut if pieces for x in pieces}, self.made).__getitem__
        whole = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [array("I", next(whole).ids).tobytes() if pieces is None else b"".join(map(ids, pieces)) for pieces in cut]


#: How the byte-level vocabularies cut texts; a fixed value of their format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MANIFEST = "part int, file string, n_docs bigint, n_ids bigint"


def write(docs: DataFrame, file: str, end_id: int, folder: str, pattern: str = BYTE_LEVEL) -> DataFrame:
    """Writes the ids of all documents under folder, in ascending doc_id order over files in order of part; gives the manifest.

    Texts are shuffled once, by ranges of doc_id. The manifest is a table in the folder: reading it doesn't write anew.
    """
    small_batches(docs.sparkSession)
    vocabulary = sent(docs.sparkSession, file)

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, name, end = None, None, f"{folder}/ids-{uuid.uuid4().hex}.bin", array("I", [end_id]).tobytes()
        for batch in slices(batches):
            if writer is None:
                encoder = PieceEncoder(vocabulary.value, pattern)
                fs, path = opened(name)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                writer = Writer(fs.open_output_stream(path), encoder.bits)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "n_docs": [len(writer.ends)], "n_ids": [writer.n_ids]})

    ordered = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text", "xxhash64(cast(text as string)) as hashed").repartitionByRange("doc_id", "hashed").sortWithinPartitions("doc_id", "hashed", "text")
    ordered.mapInArrow(written, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_back(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; a task for each file.

    The running sum of ids before each file goes over the manifest, a row per file.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "file", before.cast("long").alias("base"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, start, ids in Reader(uri).documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return files.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def new_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "ids")

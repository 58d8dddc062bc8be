"""Telemetry messages as a source of Spark: `spark.readStream.format("telemetry")`, batch too.

Messages are lines of JSON in the files of a folder, each an object with one payload: frame, metrics, status or log. Options: path (any
file system that Arrow knows, by URI); streams, a comma-separated list (none: all); frames, metrics, logs (true); bytes_per_partition.
As a subscriber gets them: frames of its streams, metrics and logs if asked for, status always. A stream's offset is how many bytes of each
file's whole lines have been read; files only grow. 64-bit numbers that messages write as strings are read as numbers.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

TRACK = "struct<id: bigint, x: double, y: double, w: double, h: double, score: double, occluded: boolean>"
SCHEMA = f"kind string, stream_id string, profile string, frame_id bigint, pts_ns bigint, width int, height int, tracks array<{TRACK}>, payload string, file string, at bigint"
KINDS = ("frame", "metrics", "status", "log")
_TAIL = 1 << 16


@dataclass(frozen=True)
class Piece(InputPartition):
    """Bytes of a file: the lines that begin in them."""

    file: str
    begin: int
    end: int


def _wanted(options: dict) -> tuple[set[str], dict[str, bool]]:
    streams = {s for s in options.get("streams", "").split(",") if s}
    yes = lambda name: str(options.get(name, "true")).lower() == "true"
    return streams, {"frame": yes("frames"), "metrics": yes("metrics"), "log": yes("logs"), "status": True}


def _number(value: object) -> int | None:
    return None if value is None else int(value)


def row_of(line: bytes, file: str, at: int, streams: set[str], kinds: dict[str, bool]) -> tuple | None:
    """A message as a row, or None if it isn't asked for or is none."""
    try:
        message = json.loads(line)
    except ValueError:
        return None
    kind = next((k for k in KINDS if isinstance(message, dict) and isinstance(message.get(k), dict)), None)
    if kind is None or not kinds[kind]:
        return None
    body = message[kind]
    of = body.get("stream") or {}
    if kind != "frame":
        return (kind, None, None, None, None, None, None, None, json.dumps(body), file, at)
    if streams and of.get("stream_id", "") not in streams:
        return None
    tracks = [(_number(t.get("id")), *(float(t.get(c) or 0) for c in ("x", "y", "w", "h", "score")), bool(t.get("occluded"))) for t in body.get("tracks") or []]
    return (kind, of.get("stream_id", ""), of.get("profile") or "ui", _number(body.get("frame_id")), _number(body.get("pts_ns")), _number(body.get("width")), _number(body.get("height")), tracks, None, file, at)


class _Files:
    """The folder, reached from driver and tasks alike."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def store(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (pa.fs.LocalFileSystem(), self.options["path"])

    def sizes(self) -> dict[str, int]:
        """Bytes of each file up to the end of its last whole line."""
        fs, path = self.store()
        found = {f.path: f.size for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)) if f.type == pa.fs.FileType.File and not f.base_name.startswith((".", "_"))}
        return {file: self.whole(fs, file, size) for file, size in sorted(found.items())}

    def whole(self, fs: pa.fs.FileSystem, file: str, size: int) -> int:
        with fs.open_input_file(file) as f:
            end = size
            while end > 0:
                begin = max(0, end - _TAIL)
                at = f.read_at(end - begin, begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        step = int(self.options.get("bytes_per_partition", 32 << 20))
        return [Piece(file, at, min(at + step, upto)) for file, upto in sorted(end.items()) for at in range(start.get(file, 0), upto, step)]

    def read(self, piece: Piece) -> Iterator[tuple]:
        streams, kinds = _wanted(self.options)
        fs, _ = self.store()
        with fs.open_input_file(piece.file) as raw, io.BufferedReader(raw, 1 << 20) as f:
            # a line belongs to the piece in which it begins
            at = piece.begin
            if at > 0:
                f.seek(at - 1)
                at = at - 1 + len(f.readline())
            else:
                f.seek(0)
            while at < piece.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                row = row_of(line, piece.file, at, streams, kinds)
                at += len(line)
                if row is not None:
                    yield row


class TelemetryReader(_Files, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return self.pieces({}, self.sizes())


class TelemetryStreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.pieces(start, end)

    def commit(self, end: dict) -> None:
        pass


class TelemetrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TelemetryReader:
        return TelemetryReader(self.options)

    def streamReader(self, schema: StructType) -> TelemetryStreamReader:
        return TelemetryStreamReader(self.options)


def waiting(path: str) -> Callable[[object], int]:
    """How many bytes of messages wait beyond an offset of a stream of this source."""
    folder = _Files({"path": path})

    def beyond(offset: object) -> int:
        read = json.loads(offset) if isinstance(offset, str) else offset or {}
        return sum(folder.sizes().values()) - sum(read.values())

    return beyond


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TelemetrySource)

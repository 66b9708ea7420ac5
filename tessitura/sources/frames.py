"""A streaming source of binary and control frames, read from append-only logs, and its writer.

A connection's frames are one log, ``<stream_id>.frames``: for each frame a header (kind, payload length) and the payload.
Logs grow while they are read. Offsets are byte positions of whole frames, by log, so a micro-batch is a set of
ranges; a restarted query reads the same ranges again. A frame's ``seq`` is its byte position, which no restart
changes. Payloads are handed on as they came: which format holds is known only in the stream's order
(``streaming.audio``).

The driver walks the headers of new frames (in blocks of 8 KB, longer payloads are skipped) to find the last whole one; payloads
are read by tasks, in ranges of at most ``rangeBytes``, short ranges of many logs by one. ``maxBytesPerBatch`` paces a micro-batch by log. The
folder must be one that ``pyarrow.fs`` opens on driver and executors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FRAMES = "stream_id string, seq long, kind string, payload binary"
HEADER = struct.Struct("<BQ")
KINDS = ("binary", "text", "open")
SUFFIX = ".frames"
#: Bytes that are read at once where headers are looked for.
BLOCK = 8192
#: Logs that a task reads at most.
LOGS_A_TASK = 128


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def encode_frames(frames: Iterable[tuple[str, bytes]]) -> bytes:
    """(kind, payload) pairs as a log has them."""
    return b"".join(HEADER.pack(KINDS.index(kind), len(payload)) + payload for kind, payload in frames)


def append_frames(path: str, stream_id: str, frames: Iterable[tuple[str, bytes]]) -> None:
    """Append to a stream's log, for file systems that can."""
    fs, folder = _folder(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_append_stream(f"{folder}/{stream_id}{SUFFIX}") as log:
        log.write(encode_frames(frames))


def last_whole_frame(log: pa.NativeFile, size: int, begin: int, most: int) -> int:
    """The end of the last whole frame behind ``begin``, one at least and about ``most`` bytes at most."""
    at, block, first = begin, b"", begin
    while at + HEADER.size <= size and (at == begin or at - begin < most):
        if at + HEADER.size > first + len(block):
            log.seek(at)
            block, first = log.read(min(BLOCK, size - at)), at
        _, length = HEADER.unpack_from(block, at - first)
        if at + HEADER.size + length > size:
            break
        at += HEADER.size + length
    return at


@dataclass
class FrameRanges(InputPartition):
    """Ranges of logs' bytes, as (file name, begin, end)."""

    path: str
    ranges: list[tuple[str, int, int]]


class FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.most = int(options.get("maxbytesperbatch", 1 << 62))
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, folder = _folder(self.path)
        for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            begin = self.ends.get(info.base_name, 0)
            if info.base_name.endswith(SUFFIX) and info.size > begin:
                with fs.open_input_file(info.path) as log:
                    self.ends[info.base_name] = last_whole_frame(log, info.size, begin, self.most)
        return {name: end for name, end in self.ends.items() if end}

    def partitions(self, start: dict, end: dict) -> list[FrameRanges]:
        out, room = [], 0
        for name, begin, stop in self._ranges(start, end):
            if not out or stop - begin > room or len(out[-1].ranges) == LOGS_A_TASK:
                out.append(FrameRanges(self.path, []))
                room = self.range_bytes
            out[-1].ranges.append((name, begin, stop))
            room -= stop - begin
        return out

    def _ranges(self, start: dict, end: dict) -> Iterator[tuple[str, int, int]]:
        fs, folder = _folder(self.path)
        for name, stop in sorted(end.items()):
            begin = start.get(name, 0)
            self.ends[name] = max(self.ends.get(name, 0), stop)  # after a restart the offsets come from the checkpoint
            if stop - begin <= self.range_bytes:
                if stop > begin:
                    yield name, begin, stop
                continue
            with fs.open_input_file(f"{folder}/{name}") as log:
                while begin < stop:
                    cut = last_whole_frame(log, stop, begin, self.range_bytes)
                    yield name, begin, cut
                    begin = cut

    def read(self, partition: FrameRanges) -> Iterator[tuple]:
        fs, folder = _folder(partition.path)
        for name, begin, end in partition.ranges:
            with fs.open_input_file(f"{folder}/{name}") as log:
                log.seek(begin)
                at = begin
                while at < end:
                    kind, length = HEADER.unpack(log.read(HEADER.size))
                    yield name.removesuffix(SUFFIX), at, KINDS[kind] if kind < len(KINDS) else None, log.read(length)
                    at += HEADER.size + length

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """``spark.readStream.format("tessitura_frames").load(folder)`` once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "tessitura_frames"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema: StructType) -> FrameReader:
        return FrameReader({k.lower(): v for k, v in self.options.items()})


def read_frames_stream(spark: SparkSession, path: str, **options: str):
    """The frames of all logs of a folder as a streaming DataFrame."""
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("tessitura_frames").options(**options).load(path)

"""Raw feature files, read in ranges: a batch source whose partitions are runs of rows of a file.

A file has two little-endian int32 (rows, width) and then rows * width float32. The driver lists the files and deals their
bytes out; each task reads a file's header for itself and then the rows that begin in its range, a block at a time, so
a file of any size is read by many tasks in bounded memory. Files of one range are read by one task in numbers. The path is a file, a folder, or a pattern of names in one; it must be one that
``pyarrow.fs`` opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "key string, frame_idx long, vec array<float>, error string"
HEADER = 8
#: Bytes that a task holds of a file at once.
BLOCK = 4 << 20
#: Files of one range, and bytes of them, that a task reads at most.
FILES_A_TASK, BYTES_A_TASK = 128, 64 << 20
#: Partitions from which on neighbours are put together, evenly.
MOST_PARTITIONS = 10_000


@dataclass
class RowRange:
    name: str
    size: int
    begin: int  # bytes behind the header
    end: int


@dataclass
class RowRanges(InputPartition):
    within: str  # the path before the names
    ranges: list[RowRange]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range_bytes = options["path"], max(1, int(options.get("rangebytes", 64 << 20)))

    def partitions(self) -> list[RowRanges]:
        fs, place = _open(self.path)
        folder, _, pattern = place.rpartition("/")
        if any(c in pattern for c in "*?["):
            infos = [i for i in fs.get_file_info(pafs.FileSelector(folder)) if fnmatchcase(i.base_name, pattern)]
        else:
            found = fs.get_file_info(place)
            pattern = pattern if found.is_file else ""
            infos = [found] if found.is_file else fs.get_file_info(pafs.FileSelector(place))
        out, small, room = [], [], 0
        for info in sorted((i for i in infos if i.is_file and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            body = max(1, info.size - HEADER)  # a broken file has one range, which says so
            ranges = [RowRange(info.base_name, info.size, at, min(at + self.range_bytes, body)) for at in range(0, body, self.range_bytes)]
            if len(ranges) > 1:
                out += [[x] for x in ranges]
                continue
            if not small or len(small) == FILES_A_TASK or room < body:
                small, room = [], BYTES_A_TASK
                out.append(small)
            small += ranges
            room -= body
        many = -(-len(out) // MOST_PARTITIONS)
        within = place.removesuffix(pattern) if pattern else f"{place.rstrip('/')}/"
        return [RowRanges(within, [x for own in out[k : k + many] for x in own]) for k in range(0, len(out), many or 1)]

    def read(self, partition: RowRanges) -> Iterator[tuple]:
        fs, _ = _open(self.path)
        for own in partition.ranges:
            yield from self._rows(fs, partition.within, own)

    def _rows(self, fs: pafs.FileSystem, within: str, own: RowRange) -> Iterator[tuple]:
        key = own.name.rsplit(".", 1)[0]
        with fs.open_input_file(within + own.name) as file:
            header = file.read(HEADER)
            rows, width = np.frombuffer(header, "<i4").tolist() if len(header) == HEADER else (-1, -1)
            wrong = "no header" if len(header) < HEADER else "negative sizes" if min(rows, width) < 0 else f"{own.size} bytes, not {HEADER + 4 * rows * width}" if own.size != HEADER + 4 * rows * width else None
            if wrong or not width:
                if wrong and own.begin == 0:
                    yield key, None, None, wrong
                return
            # rows that begin in the range
            first, last = (min(rows, -(-at // (4 * width))) for at in (own.begin, own.end))
            step = max(1, BLOCK // (4 * width))
            for at in range(first, last, step):
                many = min(step, last - at)
                file.seek(HEADER + 4 * width * at)
                block = np.frombuffer(file.read(4 * width * many), "<f4").reshape(many, width)
                for k in range(many):
                    yield key, at + k, block[k].tolist(), None


class FeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessitura_features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader({k.lower(): v for k, v in self.options.items()})

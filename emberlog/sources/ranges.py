"""Byte ranges of binary files as a data source: one large file is read by many tasks, each of which seeks to its part.

`spark.read.format("byte_ranges")` with the options `path` (a file, folder or URI that pyarrow's file systems open), `first`
(where ranges begin), `step` (their length), `extra` and `before` (bytes read beyond and ahead of each for records that
cross its ends), `most` (ranges of a file, 0 for all) and `task` (bytes of a partition) gives (source, start, ahead, size,
content): the range itself is the `size` bytes of the content that come after the first `ahead`. A file that is rewritten
while it is read gives what it holds at that time.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASK_BYTES = 32 << 20


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        number = lambda name, default: int(options.get(name, default))
        self.path = options["path"]
        self.first, self.step, self.extra, self.before, self.most = number("first", 0), number("step", 1 << 20), number("extra", 0), number("before", 0), number("most", 0)
        self.task = max(self.step, number("task", TASK_BYTES) // self.step * self.step)

    def partitions(self):
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        ends = {f.path: min(f.size, self.first + self.most * self.step) if self.most else f.size for f in files}
        parts = [_Part(path, at, min(at + self.task, end)) for path, end in ends.items() for at in range(self.first, end, self.task)]
        return parts or [_Part("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as file:
            for at in range(partition.start, partition.end, self.step):
                size = min(self.step, partition.end - at)
                ahead = min(self.before, at)
                file.seek(at - ahead)
                content = file.read(ahead + size + self.extra)
                numbers = [pa.array([v], pa.int64()) for v in (at, ahead, size)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), *numbers, pa.array([content], pa.binary())], ["source", "start", "ahead", "size", "content"])


class ByteRanges(DataSource):
    @classmethod
    def name(cls):
        return "byte_ranges"

    def schema(self):
        return "source string, start long, ahead long, size long, content binary"

    def reader(self, schema):
        return _Reader(self.options)


def byte_ranges(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(source, start, ahead, size, content) of the ranges of all files of `path`."""
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(path=path, **{k: str(v) for k, v in options.items()}).load()

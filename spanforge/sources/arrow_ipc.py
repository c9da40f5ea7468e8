"""Arrow IPC files, in file or stream format, as a Spark data source.

Paths are resolved by pyarrow's file systems: local folders, and object stores or HDFS by their URI. A file in file format
is read by as many tasks as it has runs of ``BATCHES`` record batches; one in stream format by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

BATCHES = 64


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The file itself, or the .arrow files below a folder, in order; a star in the last part of a path stands for any text."""
    system, inner = _located(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    folder, _, name = inner.rpartition("/")
    if "*" in name:
        found = system.get_file_info(pafs.FileSelector(folder or "."))
        left, right = name.split("*", 1)
        return sorted(head + f.path for f in found if f.is_file and f.base_name.startswith(left) and f.base_name.endswith(right))
    if system.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(head + f.path for f in found if f.is_file and f.base_name.endswith(".arrow"))


def _opened(path: str):
    """(reader, whether it is in file format): the file format is tried first, then the stream format."""
    system, inner = _located(path)
    source = system.open_input_file(inner)
    try:
        return pa.ipc.open_file(source), True
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source), False


def batches(path: str, first: int = 0, upto: int | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of one file, of the file format those from ``first`` to ``upto``."""
    reader, indexed = _opened(path)
    if not indexed:
        yield from reader
        return
    for i in range(first, reader.num_record_batches if upto is None else upto):
        yield reader.get_batch(i)


def file_schema(path: str) -> pa.Schema:
    return _opened(path)[0].schema


class _Part(InputPartition):
    def __init__(self, path: str, first: int, upto: int | None):
        self.path, self.first, self.upto = path, first, upto


class ArrowIpcReader(DataSourceReader):
    """A file's batches go to the JVM as they are."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        made = []
        for p in _files(self.path):
            reader, indexed = _opened(p)
            n = reader.num_record_batches if indexed else 1
            made += [_Part(p, a, min(n, a + BATCHES) if indexed else None) for a in range(0, max(1, n), BATCHES)]
        return made

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from batches(partition.path, partition.first, partition.upto)


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        return from_arrow_schema(file_schema(_files(self.options["path"])[0]))

    def reader(self, schema: StructType) -> ArrowIpcReader:
        return ArrowIpcReader(self.options["path"])


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowIpcSource)
    return spark.read.format("arrow_ipc").option("path", path).load()

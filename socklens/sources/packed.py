"""Captured records as files: packed records one after the other, nothing between them.

A Python data source cuts every file at record borders, so a file of any size
is read by many tasks, in batches of Arrow whose records are views of the bytes read. As a
stream it follows files that grow and files that come. Paths are those of
``pyarrow.fs`` (local or mounted folders, ``s3://``, ``gs://``, ``hdfs://``).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from socklens.operators.decode import record_layout
from socklens.settings import reachable

FORMAT = "packed-records"
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
SCHEMA = "file string, position bigint, record binary"


@dataclass
class Piece(InputPartition):
    """``length`` bytes of a file from ``start`` on, which is a record border."""

    file: str
    start: int
    length: int


def _files(path: str) -> dict[str, int]:
    """Files below ``path`` and their sizes; hidden ones are left out."""
    system, root = fs.FileSystem.from_uri(_uri(path))
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def _uri(path: str) -> str:
    return path if ":/" in path else f"file://{path}"


def _pieces(path: str, size: int, split: int, begin: dict[str, int], end: dict[str, int]) -> list[Piece]:
    step = max(split // size, 1) * size
    return [
        Piece(file, start, min(step, stop - start))
        for file, stop in sorted(end.items())
        for start in range(begin.get(file, 0), stop, step)
    ]


def _read(path: str, size: int, piece: Piece) -> Iterator[pa.RecordBatch]:
    """Batches of (file, position, record); a last record that is cut short comes as it is."""
    system, _ = fs.FileSystem.from_uri(_uri(path))
    step, left, at = max(BATCH_BYTES // size, 1) * size, piece.length, piece.start
    with system.open_input_file(piece.file) as source:
        while left > 0:
            data = source.read_at(min(step, left), at)
            if not data:
                return
            n = -(-len(data) // size)
            ends = np.minimum(np.arange(n + 1) * size, len(data)).astype(np.int32)
            records = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            columns = [pa.array([piece.file]).take(pa.array(np.zeros(n, np.int64))), pa.array(at // size + np.arange(n)), records]
            yield pa.RecordBatch.from_arrays(columns, ["file", "position", "record"])
            left, at = left - len(data), at + len(data)


class _BatchReader(DataSourceReader):
    def __init__(self, path: str, size: int, split: int):
        self.path, self.size, self.split = path, size, split

    def partitions(self) -> list[Piece]:
        return _pieces(self.path, self.size, self.split, {}, _files(self.path)) or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.size, piece) if piece.length else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are the whole records of each file so far, in bytes; a record that is still being written waits."""

    def __init__(self, path: str, size: int, split: int):
        self.path, self.size, self.split = path, size, split

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({f: n - n % self.size for f, n in sorted(_files(self.path).items())})}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return _pieces(self.path, self.size, self.split, json.loads(start["files"]), json.loads(end["files"])) or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return _read(self.path, self.size, piece) if piece.length else iter(())

    def commit(self, end: dict) -> None:
        pass


class PackedRecords(DataSource):
    """Options: ``path``, ``record_size`` in bytes and ``split_bytes`` of a task, about."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[str, int, int]:
        size = int(self.options.get("record_size", 0))
        if size < 1 or not self.options.get("path"):
            raise ValueError("packed records need a path and a record_size")
        return self.options["path"], size, int(self.options.get("split_bytes", SPLIT_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(*self._arguments())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._arguments())


def read_packed(
    spark: SparkSession, path: str, fields: Iterable[str], inet: int = 4, stream: bool = False, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(file, position, record) of the files below ``path``, for ``decode_records`` with the same fields and family.

    ``position`` is the number of the record in its file. A batch gives a last
    record that is cut short as it is, which decodes to NULLs; a stream waits for its rest.
    """
    reachable(spark)
    spark.dataSource.register(PackedRecords)
    _, size = record_layout(list(fields), inet)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).option("record_size", size).option("split_bytes", split_bytes).option("path", path).load()


def write_packed(df: DataFrame, path: str, record: str = "record") -> int:
    """Write a BINARY column as packed files, one per task, and give the number of records; NULLs are left out.

    A task that is repeated writes its file again.
    """
    reachable(df.sparkSession)
    system, root = fs.FileSystem.from_uri(_uri(path))
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(_uri(path))
        count = 0
        with system.open_output_stream(f"{root}/part-{TaskContext.get().partitionId():05d}") as out:
            for batch in batches:
                records = [r for r in batch.column(0).to_pylist() if r is not None]
                out.write(b"".join(records))
                count += len(records)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    return df.select(record).mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0

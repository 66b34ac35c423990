"""A data source of text lines from gzip files, whatever they are called.

``spark.read.text`` tells gzip by the file's extension. This source is given files that begin
with gzip's two magic bytes; each is one partition, as gzip can't be split, and is unpacked as
a stream of lines, so a task holds a block of it and no more.
"""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x1f\x8b"
BLOCK = 1 << 20


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(number)
        self.path = path


def unpacked(blocks):
    """The bytes of all gzip members in a stream of blocks."""
    d = zlib.decompressobj(31)
    for b in blocks:
        while b:
            yield d.decompress(b)
            b = d.unused_data if d.eof else b""
            if d.eof:
                d = zlib.decompressobj(31)


def split(blocks, sep: bytes):
    """The parts of a stream of blocks between separators; none after the last one if that ends the stream."""
    rest = b""
    for b in blocks:
        *whole, rest = (rest + b).split(sep)
        yield from whole
    if rest:
        yield rest


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.sep = json.loads(options["paths"]), options.get("lineSep", "\n")

    def partitions(self):
        return [_File(k, p) for k, p in enumerate(self.paths)]

    def read(self, partition):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_stream(path, compression=None) as f:
            rows: list[bytes] = []
            size = at = 0
            for v in split(unpacked(iter(lambda: f.read(BLOCK), b"")), self.sep.encode()):
                rows.append(v)
                size += len(v)
                if size >= BLOCK:
                    yield self._batch(rows, at, partition.path)
                    at, rows, size = at + len(rows), [], 0
            yield self._batch(rows, at, partition.path)

    @staticmethod
    def _batch(rows, at, path):
        text = pa.array([r.decode("utf-8", "replace") for r in rows], pa.string())
        return pa.record_batch([text, pa.array([path] * len(rows), pa.string()), pa.array(range(at, at + len(rows)), pa.int64())], ["value", "file", "ordinal"])


class GzipText(DataSource):
    """value, file, ordinal of every line; options: paths (a JSON list), lineSep."""

    @classmethod
    def name(cls):
        return "gzip_text"

    def schema(self):
        return "value string, file string, ordinal long"

    def reader(self, schema):
        return _Reader(self.options)


def files(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """The data files of a path, and whether each begins with the magic bytes without an extension that says so; two bytes a file are read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for f in system.globStatus(root) or []:
        for s in system.listStatus(f.getPath()) if f.isDirectory() else [f]:
            name = s.getPath().getName()
            if s.isDirectory() or name.startswith(("_", ".")):
                continue
            packed = False
            if not name.endswith(".gz"):
                stream = system.open(s.getPath())
                try:
                    packed = bytes(max(0, stream.read()) for _ in MAGIC) == MAGIC
                finally:
                    stream.close()
            out.append((str(s.getPath().toString()), packed))
    return out


def packed_lines(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    spark.dataSource.register(GzipText)
    return spark.read.format("gzip_text").options(paths=json.dumps(paths), lineSep=sep).load()

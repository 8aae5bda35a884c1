"""Byte ranges of large files: each task seeks to its own chunks, so that no file is held whole. Paths may be mounted folders or
URIs that pyarrow opens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files


class _Span(InputPartition):
    def __init__(self, file, first, last):
        super().__init__(0)
        self.file, self.first, self.last = file, first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.length = options["path"], int(options["chunkLen"])
        self.each = int(options.get("chunksPerTask", 1024))
        self.most = int(options.get("maxChunks", 0))

    def partitions(self):
        out = []
        for f, size in files.listed(self.path):
            n = -(-size // self.length)
            n = min(n, self.most) if self.most else n
            out += [_Span(f, i, min(i + self.each, n)) for i in range(0, n, self.each)]
        return out

    def read(self, partition):
        with files.reading(partition.file) as f:
            f.seek(partition.first * self.length)
            for i in range(partition.first, partition.last):
                yield partition.file, i, f.read(self.length)


class RangeSource(DataSource):
    @classmethod
    def name(cls):
        return "byte_ranges"

    def schema(self):
        return "src_id string, chunk_id long, data binary"

    def reader(self, schema):
        return _Reader(self.options)


def chunks_of(spark: SparkSession, path: str, chunk_len: int, **options) -> DataFrame:
    spark.dataSource.register(RangeSource)
    return spark.read.format("byte_ranges").options(path=path, chunkLen=chunk_len, **options).load()


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(src_id, data): one row a file, for files that fit one."""
    return spark.read.format("binaryFile").load(path).selectExpr("path AS src_id", "content AS data")

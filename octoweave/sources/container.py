"""A self-describing, checksummed file of compressed chunks, and its Spark source and sink.

Layout, little-endian: magic, version u32, flags u32, uncompressed length u64, chunk length u32, chunks u32, last chunk length u32, length of the
fingerprint u8 and the fingerprint; the streams in chunk order; the index: ``IDX1``, a first byte for each chunk, offset deltas and stream
lengths as variable-length integers, CRC-32 of the index from its mark on. With flag 1 the vocabulary (256 bits) follows the fingerprint.

The sink writes one container for each task's range of chunks, and the source reads a folder of them: the driver reads the fixed headers
only, tasks read the index of their file and the byte ranges of their chunks. Paths may be mounted folders or URIs that pyarrow opens.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.scalars import read_uvarint, uvarint
from . import files

# Fixed values of the format; a reader of other files of this layout names their magic.
MAGIC, VERSION, MARK, HAS_VOCABULARY = b"OWC1", 1, b"IDX1", 1
_HEAD = struct.Struct("<4sIIQIIIB")


class ContainerError(ValueError):
    """The file is not a whole, sound container."""


@dataclass
class Meta:
    uncompressed: int
    chunk_len: int
    n_chunks: int
    last_chunk_len: int
    fingerprint: bytes = b""
    vocabulary: bytes = b""
    first: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    payload: int = 0


def header(meta: Meta, magic: bytes = MAGIC) -> bytes:
    flags = HAS_VOCABULARY if meta.vocabulary else 0
    return _HEAD.pack(magic, VERSION, flags, meta.uncompressed, meta.chunk_len, meta.n_chunks, meta.last_chunk_len, len(meta.fingerprint)) + meta.fingerprint + meta.vocabulary


def index(first: list[int], sizes: list[int]) -> bytes:
    deltas = [0, *sizes[:-1]] if sizes else []
    body = MARK + bytes(first) + b"".join(map(uvarint, deltas)) + b"".join(map(uvarint, sizes))
    return body + struct.pack("<I", zlib.crc32(body))


def read_header(path: str, magic: bytes = MAGIC) -> Meta:
    """The header alone: no index."""
    with files.reading(path) as f:
        head = f.read(_HEAD.size)
        if len(head) < _HEAD.size or head[:4] != magic:
            raise ContainerError("not a container: the magic differs")
        _, version, flags, n, chunk_len, chunks, last, fp = _HEAD.unpack(head)
        if version != VERSION:
            raise ContainerError(f"version {version} is unknown")
        fingerprint, vocabulary = f.read(fp), f.read(32) if flags & HAS_VOCABULARY else b""
    return Meta(n, chunk_len, chunks, last, fingerprint, vocabulary, payload=_HEAD.size + fp + len(vocabulary))


def read_meta(path: str, magic: bytes = MAGIC) -> Meta:
    """Header and index; the index is the last mark whose check value holds, so that a mark among first bytes misleads nothing."""
    size, meta = files.size_of(path), read_header(path, magic)
    chunks = meta.n_chunks
    most = max(min(size - meta.payload, 4 + chunks * 21 + 4), 0)  # no index of so many chunks is longer
    with files.reading(path) as f:
        f.seek(size - most)
        tail = f.read()
    at, seen = tail.rfind(MARK), False
    while at >= 0:
        seen, body = True, tail[at:-4]
        if len(tail) - at >= 8 and struct.unpack("<I", tail[-4:])[0] == zlib.crc32(body):
            break
        at = tail.rfind(MARK, 0, at + len(MARK) - 1)
    if at < 0:
        raise ContainerError("the index's check value differs" if seen else "the index is missing")
    place = len(MARK) + chunks
    meta.first = list(body[len(MARK) : place])
    numbers = []
    for _ in range(2 * chunks):
        value, place = read_uvarint(body, place)
        numbers.append(value)
    meta.sizes, total = numbers[chunks:], 0
    for delta in numbers[:chunks]:
        total += delta
        meta.offsets.append(total)
    end = size - most + at
    for offset, length in zip(meta.offsets, meta.sizes):
        if meta.payload + offset + length > end:
            raise ContainerError("a stream's range passes the payload's end")
    return meta


def write_file(path: str, meta: Meta, streams, magic: bytes = MAGIC) -> None:
    """Writes chunks (first byte, stream) in order; memory holds one at a time."""
    first, sizes = [], []
    with files.writing(path) as f:
        f.write(header(meta, magic))
        for byte, stream in streams:
            first.append(byte or 0)
            sizes.append(len(stream))
            f.write(stream)
        f.write(index(first, sizes))


class _Range(InputPartition):
    def __init__(self, file, base, first, last):
        super().__init__(0)
        self.file, self.base, self.first, self.last = file, base, first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.magic = options["path"], options.get("magic", MAGIC.decode()).encode("latin-1")
        self.each = int(options.get("chunksPerTask", 4096))
        self.fingerprint = options.get("fingerprint")
        self.only = {int(x) for x in options["chunks"].split(",")} if options.get("chunks") else None

    def partitions(self):
        out, base = [], 0
        for file, _ in files.listed(self.path, ".owc"):
            meta = read_header(file, self.magic)
            if self.fingerprint and meta.fingerprint.hex() != self.fingerprint:
                raise ContainerError("the model is not the one that compressed this")
            for i in range(0, meta.n_chunks, self.each):
                last = min(i + self.each, meta.n_chunks)
                if self.only is None or any(base + i <= c < base + last for c in self.only):
                    out.append(_Range(file, base, i, last))
            base += meta.n_chunks
        return out

    def read(self, partition):
        meta = read_meta(partition.file, self.magic)
        with files.reading(partition.file) as f:
            for i in range(partition.first, partition.last):
                if self.only is None or partition.base + i in self.only:
                    n = meta.last_chunk_len if i == meta.n_chunks - 1 else meta.chunk_len
                    f.seek(meta.payload + meta.offsets[i])
                    yield partition.base + i, n, meta.first[i] if n else None, f.read(meta.sizes[i])


@dataclass
class _Part(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    """Tasks write hidden files as their rows come, in order of chunk_id; the commit gives them names, and with ``overwrite`` removes what
    the folder held before."""

    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.chunk_len = int(options["chunkLen"])
        self.fingerprint = bytes.fromhex(options.get("fingerprint", ""))
        self.vocabulary = bytes.fromhex(options.get("vocabulary", ""))
        self.magic = options.get("magic", MAGIC.decode()).encode("latin-1")

    def write(self, rows):
        first, sizes, n, seen, f = [], [], self.chunk_len, -1, None
        body = name = None
        try:
            for r in rows:
                if n != self.chunk_len or r["chunk_id"] <= seen:
                    raise ContainerError("only a container's last chunk may be shorter: sort chunk rows by chunk_id into ranges")
                if f is None:
                    name = f"{self.path}/.{r['chunk_id']:020d}-{uuid.uuid4().hex}.tmp"
                    body = name + ".body"
                    f = files.writing(body)
                n, seen = r["n"], r["chunk_id"]
                first.append(r["first_byte"] or 0)
                sizes.append(len(r["stream"]))
                f.write(r["stream"])
            if f is None:
                return _Part(None)
            f.close()
            meta = Meta((len(sizes) - 1) * self.chunk_len + n, self.chunk_len, len(sizes), n, self.fingerprint, self.vocabulary)
            # The header counts what the streams have told, and comes before them.
            with files.writing(name) as out, files.reading(body) as streams:
                out.write(header(meta, self.magic))
                while piece := streams.read(1 << 20):
                    out.write(piece)
                out.write(index(first, sizes))
            return _Part(name)
        finally:
            if body:
                files.remove(body)

    def commit(self, messages):
        if self.overwrite and files.located(self.path)[0].get_file_info(files.located(self.path)[1]).type.name == "Directory":
            for old, _ in files.listed(self.path, ".owc"):
                files.remove(old)
        for m in messages:
            if m is not None and m.path:
                files.move(m.path, f"{self.path}/{os.path.basename(m.path).lstrip('.').split('-')[0]}.owc")

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path:
                files.remove(m.path)


class ContainerSource(DataSource):
    @classmethod
    def name(cls):
        return "chunk_container"

    def schema(self):
        return "chunk_id long, n int, first_byte int, stream binary"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def ranged(chunks: DataFrame, parts: int) -> DataFrame:
    """Chunk rows in as many ranges of chunk_id, each in order. Before compression, so that finding the ranges compresses nothing."""
    return chunks.repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id")


def save(chunks: DataFrame, path: str, chunk_len: int, fingerprint: bytes = b"", vocabulary: bytes = b"", mode: str = "append") -> None:
    """Writes compressed rows of one source, whose chunks were ``ranged``, as a folder of containers: one for each range. ``mode``: append
    or overwrite."""
    chunks.sparkSession.dataSource.register(ContainerSource)
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "n", "first_byte", "stream").write.format("chunk_container").mode(mode)
    rows.options(path=path, chunkLen=chunk_len, fingerprint=fingerprint.hex(), vocabulary=vocabulary.hex()).save()


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """(chunk_id, n, first_byte, stream); options: chunks (ids to read alone), fingerprint (to check), chunksPerTask, magic."""
    spark.dataSource.register(ContainerSource)
    return spark.read.format("chunk_container").options(path=path, **options).load()


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of a container: its header's numbers."""
    rows = [(os.path.basename(f), m.uncompressed, m.chunk_len, m.n_chunks, m.last_chunk_len, m.fingerprint.hex()) for f, _ in files.listed(path, ".owc") for m in [read_header(f)]]
    return spark.createDataFrame(rows, "file string, uncompressed_len long, chunk_len int, n_chunks int, last_chunk_len int, fingerprint string")

"""Byte and byte-pair counts: partial counts in numpy beside the scan, then one small shuffle.

One row for each byte would multiply the data by thirty; a task's partial counts are at most 256 or 65,536 rows for each key instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are counted or replaced at once; what a task needs beside its Arrow batch is a few times this.
PIECE_BYTES = 1 << 19


def _buffer(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_counts(docs: DataFrame, data: str = "data", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, byte, n) of all bytes of a BINARY column; keys are strings."""

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _counted(batch, data, keys, False)

    schema = "".join(f"{k} string, " for k in keys) + "byte int, n long"
    rows = docs.select(*(F.col(k).cast("string").alias(k) for k in keys), data).mapInArrow(count, schema)
    return rows.groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, data: str = "data", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ctx, byte, n): how often a byte follows another within a value; the first byte of a value follows none."""

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _counted(batch, data, keys, True)

    schema = "".join(f"{k} string, " for k in keys) + "ctx int, byte int, n long"
    rows = docs.select(*(F.col(k).cast("string").alias(k) for k in keys), data).mapInArrow(count, schema)
    return rows.groupBy(*keys, "ctx", "byte").agg(F.sum("n").alias("n"))


def _counted(batch, data: str, keys: tuple[str, ...], pairs: bool):
    raw, off = _buffer(batch.column(data))
    names = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
    groups = {name: i for i, name in enumerate(dict.fromkeys(names))}
    of = np.array([groups[n] for n in names])
    width = 65536 if pairs else 256
    totals = np.zeros((len(groups), width), np.int64)
    for a in range(0, len(raw), PIECE_BYTES):
        b = min(a + PIECE_BYTES, len(raw))
        piece = raw[a:b].astype(np.int64)
        first, last = int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, b, "left"))
        cell = np.repeat(of[first:last] * width, np.diff(np.clip(off[first : last + 1], a, b))) + piece
        if pairs:
            cell += 256 * (np.r_[raw[a - 1], raw[a : b - 1]] if a else np.r_[0, raw[: b - 1]]).astype(np.int64)
            inner = np.ones(b - a, bool)
            starts = off[:-1][np.diff(off) > 0]
            inner[starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a] = False
            cell = cell[inner]
        totals += np.bincount(cell, minlength=totals.size).reshape(totals.shape)
    g, v = np.nonzero(totals)
    columns = {k: pa.array([list(groups)[x][c] for x in g], pa.string()) for c, k in enumerate(keys)}
    if pairs:
        columns |= {"ctx": pa.array(v // 256, pa.int32())}
    yield pa.record_batch(columns | {"byte": pa.array(v % 256, pa.int32()), "n": pa.array(totals[g, v], pa.int64())})


def dense(counts: DataFrame) -> DataFrame:
    """All 256 bytes, those that do not occur with 0."""
    spark = counts.sparkSession
    every = spark.range(256).select(F.col("id").cast("int").alias("byte"))
    return every.join(F.broadcast(counts), "byte", "left").select("byte", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # at most 256 rows


def vocabulary(counts: DataFrame) -> DataFrame:
    """(byte, idx): the bytes that occur, numbered in order."""
    # at most 256 rows: their order by aggregation, not by a window without keys
    ordered = counts.where("n > 0").agg(F.array_sort(F.collect_set("byte")).alias("v"))
    return ordered.select(F.posexplode("v").alias("idx", "byte")).select("byte", "idx")


def remapped(docs: DataFrame, table: dict[int, int], data: str = "data") -> DataFrame:
    """Each byte replaced through a table of at most 256 entries; a byte outside the table is an error."""
    lut, known = np.zeros(256, np.uint8), np.zeros(256, bool)
    lut[list(table)], known[list(table)] = list(table.values()), True

    def remap(batches):
        for batch in batches:
            raw, off = _buffer(batch.column(data))
            i = 0
            while i < batch.num_rows:  # rows of about PIECE_BYTES, one at least
                j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE_BYTES, "right")) - 1)
                piece = raw[off[i] : off[j]]
                if not (fine := known[piece]).all():
                    raise ValueError(f"bytes outside the vocabulary: {sorted(set(piece[~fine].tolist()))}")
                arr = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((off[i : j + 1] - off[i]).astype(np.int32)), pa.py_buffer(lut[piece])])
                yield batch.slice(i, j - i).set_column(batch.schema.get_field_index(data), data, arr)
                i = j

    return docs.mapInArrow(remap, docs.schema)

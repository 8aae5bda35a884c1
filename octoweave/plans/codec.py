"""Compression of chunk rows: the first byte stands raw, the others go through predictor and coder; one Arrow batch is one set of lanes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.scalars import words_le
from .coder import Decoder, Encoder

#: Lanes that step together, and what their table may hold.
LANES, TABLE_BYTES = 4096, 128 << 20


def encode(lanes: list[np.ndarray], model) -> list[np.ndarray]:
    """Words of each lane's symbols after the first."""
    order = np.argsort([-len(x) for x in lanes], kind="stable")
    sizes = np.array([len(lanes[i]) for i in order])
    out: list = [np.zeros(0, np.uint32)] * len(lanes)
    if not len(lanes) or sizes[0] < 2:
        return out
    table = np.zeros((len(lanes), sizes[0]), np.int64)
    for row, i in zip(table, order):
        row[: len(lanes[i])] = lanes[i]
    table = np.ascontiguousarray(table.T)
    coder, state = Encoder(len(lanes), int(sizes[0])), model.start(len(lanes))
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # lanes longer than t
    counted = getattr(model, "cdf", None)
    for t in range(1, int(sizes[0])):
        n = int(active[t])
        previous, symbol = table[t - 1, :n], table[t, :n]
        if counted is not None:
            row = model.rows(previous)
            coder.step(n, counted[row, symbol], counted[row, symbol + 1])
        else:
            bounds = model.bounds(state, previous)
            coder.step(n, bounds[np.arange(n), symbol], bounds[np.arange(n), symbol + 1])
    for i, words in zip(order, coder.finish()):
        out[i] = words
    return out


def decode(streams: list[np.ndarray], first: np.ndarray, sizes: np.ndarray, model) -> list[np.ndarray]:
    order = np.argsort(-np.asarray(sizes), kind="stable")
    ordered = np.asarray(sizes)[order]
    if not len(order) or ordered[0] < 1:
        return [np.zeros(0, np.uint8) for _ in streams]
    table = np.zeros((int(ordered[0]), len(order)), np.int64)
    table[0] = np.asarray(first)[order]
    coder, state = Decoder([streams[i] for i in order]), model.start(len(order))
    active = np.searchsorted(-ordered, -np.arange(int(ordered[0])), "left")
    counted = getattr(model, "cdf", None)
    for t in range(1, int(ordered[0])):
        n = int(active[t])
        if counted is not None:
            row = model.rows(table[t - 1, :n])
            table[t, :n] = symbol = model.find(row, coder.target(n))
            coder.step(n, counted[row, symbol], counted[row, symbol + 1])
            continue
        bounds = model.bounds(state, table[t - 1, :n])
        target = coder.target(n)
        symbol = _find(bounds, target)
        table[t, :n] = symbol
        coder.step(n, bounds[np.arange(n), symbol], bounds[np.arange(n), symbol + 1])
    out: list = [None] * len(order)
    for column, i in enumerate(order):
        out[i] = table[: sizes[i], column].astype(np.uint8)
    return out


def _find(bounds: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The symbol whose interval holds each target, by bisection of all rows at once."""
    lo, hi, row = np.zeros(len(target), np.int64), np.full(len(target), bounds.shape[1] - 1), np.arange(len(target))
    for _ in range(int(bounds.shape[1]).bit_length()):
        middle = (lo + hi) >> 1
        right = bounds[row, middle] <= target
        lo, hi = np.where(right, middle, lo), np.where(right, hi, middle)
        if (hi - lo <= 1).all():
            break
    return lo


def lane_runs(sizes: np.ndarray):
    """(first, count) of runs of lanes: LANES at most, and fewer where the longest would make a table of more than TABLE_BYTES."""
    at = 0
    while at < len(sizes):
        longest = np.maximum.accumulate(np.maximum(sizes[at : at + LANES], 1))
        count = max(1, int(np.searchsorted(longest * np.arange(1, len(longest) + 1) * 8, TABLE_BYTES, "right")))
        yield at, count
        at += count


def spread(chunks: DataFrame) -> DataFrame:
    """Chunk rows dealt over all cores where fewer tasks than cores would hold them: coding costs far more than moving the bytes."""
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.repartition(cores) if chunks.rdd.getNumPartitions() < cores else chunks


def compress(chunks: DataFrame, model, data: str = "data") -> DataFrame:
    """Chunk rows with n, first_byte and stream (32-bit words, little-endian) in place of their bytes; empty chunks have no first byte."""
    others = [f for f in chunks.schema.fields if f.name != data]

    def squeeze(batches):
        for whole in batches:
            for at, count in lane_runs(pc.fill_null(pc.binary_length(whole.column(data)), 0).to_numpy(zero_copy_only=False)):
                batch = whole.slice(at, count)
                lanes = [np.frombuffer(b or b"", np.uint8) for b in batch.column(data).to_pylist()]
                streams = [words_le(w) for w in encode(lanes, model)]
                first = [int(x[0]) if len(x) else None for x in lanes]
                yield pa.record_batch({f.name: batch.column(f.name) for f in others} | {"n": pa.array([len(x) for x in lanes], pa.int32()), "first_byte": pa.array(first, pa.int32()), "stream": pa.array(streams, pa.binary())})

    return chunks.mapInArrow(squeeze, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others) + "n int, first_byte int, stream binary")


def decompress(chunks: DataFrame, model, data: str = "data") -> DataFrame:
    """The way back."""
    others = [f for f in chunks.schema.fields if f.name not in ("n", "first_byte", "stream")]

    def expand(batches):
        for whole in batches:
            for at, count in lane_runs(whole.column("n").to_numpy(zero_copy_only=False)):
                batch = whole.slice(at, count)
                streams = [np.frombuffer(s, "<u4") for s in batch.column("stream").to_pylist()]
                first = np.array([b or 0 for b in batch.column("first_byte").to_pylist()])
                lanes = decode(streams, first, np.array(batch.column("n")), model)
                yield pa.record_batch({f.name: batch.column(f.name) for f in others} | {data: pa.array([x.tobytes() for x in lanes], pa.binary())})

    return chunks.mapInArrow(expand, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others) + f"{data} binary")

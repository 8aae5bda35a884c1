"""Typed views of bytes: fixed records, padded jagged rows and their sidecar, column histograms and ranges."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDECAR = "n_events long, tree_key string, branches array<struct<name: string, is_list: boolean, max_len: int, dtype: string, col_offset: int>>, lengths map<string, array<int>>"


def flat_records(docs: DataFrame, columns: list[str], kind: str = "<f4", data: str = "data", key: str = "src_id", exact: bool = True, max_rows: int | None = None) -> DataFrame:
    """(key, row, columns): each value's bytes as rows of so many numbers, the first ``max_rows``; a last part of a row is an error, or dropped
    if not ``exact``. Then a value of less than one row is the error."""
    width = len(columns)
    out = np.dtype(kind)
    name = {"f4": "float", "f8": "double", "i4": "int", "i8": "long"}[out.str[1:]]

    def view(batches):
        for batch in batches:
            ids, rows, parts = [], [], []
            for k, b in zip(batch.column(key).to_pylist(), batch.column(data).to_pylist()):
                size = width * out.itemsize
                if len(b) % size and exact:
                    raise ValueError(f"{len(b)} bytes are not whole rows of {size}")
                if not len(b) // size and not exact:
                    raise ValueError(f"{len(b)} bytes are less than one row of {size}")
                n = len(b) // size if max_rows is None else min(len(b) // size, max_rows)
                m = np.frombuffer(b, out, n * width).reshape(-1, width)
                ids += [k] * len(m)
                rows.append(np.arange(len(m)))
                parts.append(m)
            m = np.concatenate(parts) if parts else np.zeros((0, width), out)
            yield pa.record_batch({key: pa.array(ids, batch.schema.field(key).type), "row": np.concatenate(rows) if rows else np.zeros(0, np.int64)} | {c: np.ascontiguousarray(m[:, i]) for i, c in enumerate(columns)})

    return docs.select(key, data).mapInArrow(view, f"{key} {dict(docs.dtypes)[key]}, row long, " + ", ".join(f"`{c}` {name}" for c in columns))


def packed_records(rows: DataFrame, array: str, kind: str = "<f4", data: str = "data") -> DataFrame:
    """An array column as the bytes of its numbers, row by row."""
    others = [c for c in rows.columns if c != array]

    def pack(batches):
        for batch in batches:
            packed = [np.asarray(v, kind).tobytes() if v is not None else None for v in batch.column(array).to_pylist()]
            yield pa.record_batch({c: batch.column(c) for c in others} | {data: pa.array(packed, pa.binary())})

    fields = [f for f in rows.schema.fields if f.name != array]
    return rows.mapInArrow(pack, T.StructType([*fields, T.StructField(data, T.BinaryType())]))


def matrix_cells(rows: DataFrame, array: str, key: str) -> DataFrame:
    """(key, col, value) of an array column."""
    return rows.select(key, F.posexplode(array).alias("col", "value"))


def branches(schema: T.StructType) -> tuple[list[str], list[str]]:
    """(scalar, list) columns that are numbers or lists of numbers."""
    scalar = [f.name for f in schema if isinstance(f.dataType, T.NumericType)]
    lists = [f.name for f in schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]
    return scalar, lists


def sidecar(events: DataFrame, names: list[str], tree: str = "events") -> dict:
    """What padded rows do not say: for each branch its width and where it starts. One row of maxima reaches the driver."""
    kinds = {f.name: isinstance(f.dataType, T.ArrayType) for f in events.schema}
    got = events.agg(F.count("*").alias("n"), *(F.coalesce(F.max(F.size(c)), F.lit(0)).alias(c) for c in names if kinds[c])).first()
    out, at = [], 0
    for c in names:
        width = max(got[c], 0) if kinds[c] else 1
        out.append({"name": c, "is_list": kinds[c], "max_len": width, "dtype": "float64", "col_offset": at})
        at += width
    return {"n_events": got["n"], "tree_key": tree, "branches": out}


def padded(events: DataFrame, meta: dict, key: str) -> DataFrame:
    """(key, row, lengths): every branch padded with zeros to its width, side by side; lengths of the list branches."""
    parts = []
    for b in meta["branches"]:
        c = F.col(b["name"])
        values = F.transform(F.coalesce(c, F.array().cast("array<double>")), lambda v: F.coalesce(v.cast("double"), F.lit(0.0))) if b["is_list"] else F.array(F.coalesce(c.cast("double"), F.lit(0.0)))
        parts.append(F.concat(values, F.array_repeat(F.lit(0.0), F.lit(b["max_len"]) - F.size(values))) if b["is_list"] else values)
    lengths = F.create_map(*[x for b in meta["branches"] if b["is_list"] for x in (F.lit(b["name"]), F.greatest(F.size(b["name"]), F.lit(0)))]) if any(b["is_list"] for b in meta["branches"]) else F.create_map().cast("map<string,int>")
    return events.select(key, F.concat(*parts).alias("row"), lengths.alias("lengths"))


def unpadded(rows: DataFrame, meta: dict, key: str) -> DataFrame:
    """The branches back from padded rows; a row of another width is an error."""
    width = sum(b["max_len"] for b in meta["branches"])
    row = F.when(F.size("row") == width, F.col("row")).otherwise(F.raise_error(F.lit(f"a row is not {width} wide")).cast("array<double>"))
    out = []
    for b in meta["branches"]:
        n = F.least(F.coalesce(F.col("lengths")[b["name"]], F.lit(0)), F.lit(b["max_len"]))
        out.append((F.slice(row, F.lit(b["col_offset"] + 1), n) if b["is_list"] else F.get(row, F.lit(b["col_offset"]))).alias(b["name"]))
    return rows.select(key, *out)


def sidecar_json(meta: dict) -> str:
    return json.dumps(meta, sort_keys=True)


def column_ranges(cells: DataFrame) -> DataFrame:
    """(col, n, mean, std, lo, hi) of values that are not NaN; the deviation is the population's."""
    good = cells.where(~F.isnan("value"))
    return good.groupBy("col").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def column_histogram(cells: DataFrame, ranges: DataFrame, bins: int) -> DataFrame:
    """(col, bin, n): equal bins between each column's bounds, the last closed above; columns of one value fill bin 0."""
    width = F.col("hi") - F.col("lo")
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(bins - 1)))
    return cells.where(~F.isnan("value")).join(F.broadcast(ranges.select("col", "lo", "hi")), "col").groupBy("col", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # a row for each column


def common_length(a: DataFrame, b: DataFrame, key: str, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """Both sides' values cut to the shorter one's length; keys that one side lacks go."""
    sizes = a.select(key, F.octet_length(data).alias("m_")).join(b.select(key, F.octet_length(data).alias("n_")), key).select(key, F.least("m_", "n_").alias("k_"))
    cut = lambda df: df.join(sizes, key).withColumn(data, F.substring(F.col(data), F.lit(1), F.col("k_"))).drop("k_")
    return cut(a), cut(b)


def first_events(events: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` events in order, all if there are fewer: each task keeps that many."""
    return events.orderBy(*order).limit(most)


def byte_budget(docs: DataFrame, bucket: Column, order: list, size: str, budget: int) -> DataFrame:
    """The first rows in order up to so many bytes, with ``kept``: how many of each are within. ``bucket`` must rise with the order; its
    running totals come first, a row for each bucket, those within the budget are joined, and running sums stay within buckets, so that
    no window holds all rows."""
    placed = docs.withColumn("bucket_", bucket)
    totals = placed.groupBy("bucket_").agg(F.sum(size).alias("t_"))
    before = totals.select("bucket_", (F.sum("t_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t_")).alias("before_")).where(F.col("before_") < budget)
    run = F.sum(size).over(Window.partitionBy("bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size)
    placed = placed.join(before, "bucket_").withColumn("at_", F.col("before_") + run).where(F.col("at_") < budget)
    return placed.withColumn("kept", F.least(F.col(size), F.lit(budget) - F.col("at_"))).drop("bucket_", "before_", "at_")

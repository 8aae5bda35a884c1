"""Chunk plans and chunk rows: a source's bytes cut into independent pieces of equal length, the last one shorter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_plan(sized: DataFrame, n: str = "n_bytes", seq_size: int = 0, chunks: int = 0) -> DataFrame:
    """Adds chunk_len, n_chunks and last_chunk_len. ``seq_size`` wins over ``chunks``; with ``chunks`` the length is the quotient rounded
    up, and as many chunks as that needs are made, so that none is empty. Empty sources are an error, as is neither parameter."""
    if not seq_size and not chunks:
        raise ValueError("name seq_size or chunks")
    size = F.when(F.col(n) > 0, F.col(n)).otherwise(F.raise_error(F.lit("an empty source has no chunks")).cast("long"))
    length = F.lit(seq_size).cast("long") if seq_size else F.ceil(size / F.lit(max(chunks, 1))).cast("long")
    planned = sized.withColumn("chunk_len", length).withColumn("n_chunks", F.ceil(size / F.col("chunk_len")).cast("int"))
    return planned.withColumn("last_chunk_len", F.col(n) - (F.col("n_chunks") - 1) * F.col("chunk_len"))


def chunk_ranges(planned: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each chunk: chunk_id, offset and chunk_bytes; ``most``: only each source's first so many."""
    last = F.col("n_chunks") - 1 if most is None else F.least(F.col("n_chunks"), F.lit(most)) - 1
    rows = planned.withColumn("chunk_id", F.explode(F.sequence(F.lit(0), last)))
    offset = F.col("chunk_id").cast("long") * F.col("chunk_len")
    return rows.withColumn("offset", offset).withColumn("chunk_bytes", F.when(F.col("chunk_id") == F.col("n_chunks") - 1, F.col("last_chunk_len")).otherwise(F.col("chunk_len")))


def chunk_slice(data: str = "data") -> Column:
    """The bytes of a chunk row."""
    return F.substring(F.col(data), (F.col("offset") + 1).cast("int"), F.col("chunk_bytes").cast("int"))


def first_byte(data: Column) -> Column:
    return F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")


def joined(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """The ordered concatenation of each source's chunks; a source's bytes meet in one row, so it must fit one."""
    parts = F.array_sort(F.collect_list(F.struct(order, data)))
    return chunks.groupBy(key).agg(parts.alias("parts")).select(key, F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p[data])).alias(data))

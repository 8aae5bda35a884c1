"""The index of compressed chunks: offsets, deltas, sizes and check values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import uvarint_length


def offsets(chunks: DataFrame, key: str, size: str, order: str = "chunk_id") -> DataFrame:
    """Adds offset (bytes of the chunks before), delta (offset less the one before) and the bytes both take in the index."""
    by = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    out = chunks.withColumn("offset", before)
    out = out.withColumn("delta", F.col("offset") - F.lag("offset", 1, 0).over(by))
    return out.withColumns({"delta_bytes": uvarint_length(F.col("delta")), "size_bytes": uvarint_length(F.col(size))})


def payload_slice(payload: Column, offset: Column, size: Column) -> Column:
    return F.substring(payload, (offset + 1).cast("int"), size.cast("int"))


def interval(cdf: DataFrame, asked: DataFrame, q: str = "q") -> DataFrame:
    """Joins each q to the symbol with lo <= q < hi. The table has at most 256 rows, so it is broadcast and each row looks its own up."""
    return asked.join(F.broadcast(cdf), (F.col(q) >= F.col("lo")) & (F.col(q) < F.col("hi")))

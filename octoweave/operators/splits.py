"""Contiguous splits and batches of byte sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("train", "val", "test")


def aligned(n: Column, seq_len: int, batch: int) -> Column:
    """n cut down to whole blocks of batch sequences."""
    block = seq_len * batch
    return (F.floor(n / block) * block).cast("long")


def split_sizes(sized: DataFrame, seq_len: int, batch: int, shares=(0.8, 0.1, 0.1), n: str = "n_bytes") -> DataFrame:
    """Adds usable, n_train, n_val, n_test: parts are aligned down one by one, remainders dropped."""
    if abs(sum(shares) - 1) >= 1e-6:
        raise ValueError("shares must sum to 1")
    out = sized.withColumn("usable", aligned(F.col(n), seq_len, batch))
    for name, share in zip(NAMES[:2], shares):
        out = out.withColumn(f"n_{name}", aligned(F.floor(F.col("usable") * F.lit(share)), seq_len, batch))
    return out.withColumn("n_test", aligned(F.col("usable") - F.col("n_train") - F.col("n_val"), seq_len, batch))


def split_of(pos: Column) -> Column:
    """The split that a position falls in, null past the last; beside split_sizes' columns."""
    return F.when(pos < F.col("n_train"), "train").when(pos < F.col("n_train") + F.col("n_val"), "val").when(pos < F.col("n_train") + F.col("n_val") + F.col("n_test"), "test")


def cut_of(pos: Column, n: Column, first: float = 0.8, second: float = 0.9) -> Column:
    """Splits at unaligned shares of the length."""
    return F.when(pos < F.floor(n * first), "train").when(pos < F.floor(n * second), "val").otherwise("test")


def split_slices(docs: DataFrame, data: str = "data") -> DataFrame:
    """One row for each split that is not empty: split, and its bytes; beside split_sizes' columns."""
    at, parts = F.lit(0).cast("long"), []
    for name in NAMES:
        size = F.col(f"n_{name}")
        parts.append(F.struct(F.lit(name).alias("split"), F.substring(F.col(data), (at + 1).cast("int"), size.cast("int")).alias("part"), size.alias("size")))
        at = at + size
    return docs.withColumn("p", F.explode(F.array(*parts))).where("p.size > 0").select(*[c for c in docs.columns if c != data], F.col("p.split").alias("split"), F.col("p.part").alias(data))


def batch_rows(sized: DataFrame, seq_len: int, batch: int, n: str = "n_bytes", most: int | None = None) -> DataFrame:
    """(batch_id, row_id, offset) of each whole batch's sequences; ``most``: the first so many batches."""
    count = F.floor(F.col(n) / (seq_len * batch)).cast("int")
    count = count if most is None else F.least(count, F.lit(most))
    rows = sized.where(count > 0).withColumn("s", F.explode(F.sequence(F.lit(0), count * batch - 1)))
    return rows.withColumn("batch_id", F.floor(F.col("s") / batch).cast("int")).withColumn("row_id", F.col("s") % batch).withColumn("offset", F.col("s").cast("long") * seq_len).drop("s")

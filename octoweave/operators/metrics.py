"""Evaluation of a next-byte predictor from counts.

A predictor of order 1 says the same for every position after the same byte, so that all of its metrics follow from (ctx, byte, n)
counts: at most 65,536 rows a split, whatever the corpus. ``outcomes`` makes them once; the metrics are aggregations over them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = 256


def bits_per_byte(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """n and mean bits a byte; no bytes count as one."""
    return outcomes.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(-F.log2("p") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("bpb"))


def entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Order-0 entropy in bits a byte of (keys, byte, n) counts."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n_bytes"))
    each = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))  # one row
    return each.groupBy(*keys, "n_bytes").agg(F.sum(-F.col("n") / F.col("n_bytes") * F.log2(F.col("n") / F.col("n_bytes"))).alias("bits"))


def model_table(pairs: DataFrame) -> DataFrame:
    """(ctx, byte, c, total, p, rank): the smoothed model of (ctx, byte, n) counts, dense in bytes for each context seen. Counts start
    at one; ties rank the lower byte first. At most 65,536 rows."""
    spark = pairs.sparkSession
    grid = pairs.select("ctx").distinct().crossJoin(F.broadcast(spark.range(SYMBOLS).select(F.col("id").cast("int").alias("byte"))))  # 256 rows by 256
    seen = grid.join(pairs, ["ctx", "byte"], "left").select("ctx", "byte", (F.coalesce("n", F.lit(0)) + 1).alias("c"))
    by = Window.partitionBy("ctx")
    return seen.withColumn("total", F.sum("c").over(by)).withColumn("p", F.col("c") / F.col("total")).withColumn("rank", F.row_number().over(by.orderBy(F.desc("c"), "byte")))


def outcomes(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """(keys, ctx, byte, n, p, rank, pred, conf): what the model said of each pair; contexts it never saw are uniform and say byte 0."""
    top = model.where("rank = 1").select("ctx", F.col("byte").alias("pred"), F.col("p").alias("conf"))
    out = pairs.join(model.select("ctx", "byte", "p", "rank"), ["ctx", "byte"], "left").join(top, "ctx", "left")
    return out.withColumns({"p": F.coalesce("p", F.lit(1.0 / SYMBOLS)), "rank": F.coalesce("rank", F.col("byte") + 1), "pred": F.coalesce("pred", F.lit(0)), "conf": F.coalesce("conf", F.lit(1.0 / SYMBOLS))})


def top_k(outcomes: DataFrame, most: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, accuracy) for k = 1..most: the share of positions whose byte is among the k likeliest."""
    ks = outcomes.sparkSession.range(1, min(most, SYMBOLS) + 1).select(F.col("id").cast("int").alias("k"))
    per = outcomes.groupBy(*keys, "rank").agg(F.sum("n").alias("n"))
    return per.crossJoin(F.broadcast(ks)).groupBy(*keys, "k").agg((F.sum(F.when(F.col("rank") <= F.col("k"), F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("accuracy"))


def confusion(outcomes: DataFrame, ignore: int | None = None) -> DataFrame:
    """(y, pred, n), without true byte ``ignore``."""
    rows = outcomes if ignore is None else outcomes.where(F.col("byte") != ignore)
    return rows.groupBy(F.col("byte").alias("y"), "pred").agg(F.sum("n").alias("n"))


def top_classes(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` commonest true bytes, ties to the lower."""
    return counts.groupBy("y").agg(F.sum("n").alias("support")).orderBy(F.desc("support"), "y").limit(most)


def normalised(counts: DataFrame, most: int, by: str) -> DataFrame:
    """(y, pred, n, share) over the commonest classes on both axes; by true, pred, all or none, within that square; empty lines are 0."""
    top = top_classes(counts, most).select("y")
    square = counts.join(F.broadcast(top), "y").join(F.broadcast(top.select(F.col("y").alias("pred"))), "pred")  # ``most`` rows each
    of = {"true": ["y"], "pred": ["pred"], "all": [F.lit(0)], "none": None}[by]
    share = F.col("n").cast("double") if of is None else F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy(*of)), F.lit(1))
    return square.select("y", "pred", "n", share.alias("share"))


def per_class(counts: DataFrame, most: int) -> DataFrame:
    """(byte, support, precision, recall, f1) of the commonest classes, from the full matrix."""
    true = counts.groupBy(F.col("y").alias("byte")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    said = counts.groupBy(F.col("pred").alias("byte")).agg(F.sum("n").alias("said"))
    out = true.join(said, "byte", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    out = out.withColumns({"precision": F.col("hits") / F.greatest("said", F.lit(1)), "recall": F.col("hits") / F.greatest("support", F.lit(1))})
    out = out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))
    return out.orderBy(F.desc("support"), "byte").limit(most).select("byte", "support", "precision", "recall", "f1")


def uniform_edges(bins: int) -> list[float]:
    return np.linspace(0, 1, bins + 1).tolist()


def quantile_edges(outcomes: DataFrame, bins: int) -> list[float]:
    """Distinct exact quantiles of the confidence over all positions; uniform edges if there are fewer than two. An order-1 model has at
    most 257 confidences, so their histogram is small."""
    shares = np.linspace(0, 1, bins + 1)
    rows = outcomes.groupBy("conf").agg(F.sum("n").alias("n")).agg(F.percentile("conf", F.array(*map(F.lit, shares.tolist())), F.col("n")).alias("q")).first()
    edges = np.unique(rows["q"]).tolist() if rows["q"] else []
    return edges if len(edges) >= 2 else uniform_edges(bins)


def bin_of(x: Column, edges: list[float]) -> Column:
    """The bin (e_i, e_{i+1}] of x, the first closed below; values past either end fall in the end bins."""
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)) - 1
    return F.least(F.greatest(below, F.lit(0)), F.lit(len(edges) - 2))


def calibration(outcomes: DataFrame, edges: list[float], keys: tuple[str, ...] = ("split",), ignore: int | None = None) -> DataFrame:
    """(keys, bin, n, conf, acc) of each bin that is not empty."""
    rows = outcomes if ignore is None else outcomes.where(F.col("byte") != ignore)
    hit = F.when(F.col("pred") == F.col("byte"), F.col("n")).otherwise(0)
    return rows.groupBy(*keys, bin_of(F.col("conf"), edges).alias("bin")).agg(F.sum("n").alias("n"), (F.sum(F.col("conf") * F.col("n")) / F.sum("n")).alias("conf"), (F.sum(hit) / F.sum("n")).alias("acc"))


def expected_error(curve: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """(keys, ece): the mean gap between accuracy and confidence, weighted by bin size."""
    return curve.groupBy(*keys).agg((F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("ece"))

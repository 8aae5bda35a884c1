"""Ordered operators: causal convolution and linear recurrence over a value's sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def causal_convolution(rows: DataFrame, key: str, order: str, value: str, weights: list[float], bias: float = 0.0) -> DataFrame:
    """Adds ``conv``: the weighted sum of the current value (last weight) and those before it, places before the first counting as 0."""
    by, last = Window.partitionBy(key).orderBy(order), len(weights) - 1
    terms = [F.coalesce(F.lag(value, last - i).over(by) if i < last else F.col(value), F.lit(0.0)) * w for i, w in enumerate(weights)]
    return rows.withColumn("conv", sum(terms[1:], terms[0]) + bias)


def recurrence(values: Column, decay: Column, gain: Column) -> Column:
    """The state after h = decay h + gain x over an array, from 0: an ordered fold within one row."""
    return F.aggregate(values, F.lit(0.0), lambda h, x: decay * h + gain * x)


def selective_recurrence(values: Column, steps: Column) -> Column:
    """The state after h = exp(-dt) h + dt x over two arrays, from 0: each element's own step says how much is kept and taken."""
    pairs = F.zip_with(values, steps, lambda x, dt: F.struct(x.alias("x"), dt.alias("dt")))
    return F.aggregate(pairs, F.lit(0.0), lambda h, p: F.exp(-p["dt"]) * h + p["dt"] * p["x"])


def cumulative_hits(rows: DataFrame, keys: list[str], rank: str, hit: str) -> DataFrame:
    """Adds ``seen``: whether a hit stands at this rank or a better one."""
    by = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("seen", F.max(hit).over(by))

"""Exact and approximate comparison of what went in with what came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RTOL, ATOL = 1e-5, 1e-8


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first byte that differs, for values of one length that differ somewhere. The part that is equal grows by halving
    steps, 2 ** i bytes where those are equal too, so that all steps together read a few times the value's length."""
    top = F.floor(F.log2(F.length(a))).cast("int")

    def grown(at: Column, i: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), i)
        return at + F.when(F.substring(a, at + 1, step) == F.substring(b, at + 1, step), step).otherwise(0)

    return F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.lit(0), grown)


def verify_bytes(a: DataFrame, b: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, status, size_a, size_b, first_diff): ok, sizes differ or bytes differ. Only unequal values of one size are searched for
    their first difference."""
    x = a.select(key, F.col(data).alias("a"))
    y = b.select(key, F.col(data).alias("b"))
    both = x.join(y, key, "full")
    size_a, size_b = F.coalesce(F.length("a"), F.lit(0)), F.coalesce(F.length("b"), F.lit(0))
    status = F.when(size_a != size_b, "sizes differ").when(F.col("a").eqNullSafe(F.col("b")), "ok").otherwise("bytes differ")
    first = F.when(status == "bytes differ", first_difference(F.col("a"), F.col("b")).cast("long"))
    return both.select(key, status.alias("status"), size_a.alias("size_a"), size_b.alias("size_b"), first.alias("first_diff"))


def exact(a: Column, b: Column) -> Column:
    """Equality in which NaN equals nothing, null nothing."""
    return F.coalesce((a == b) & ~F.isnan(a), F.lit(False))


def close(a: Column, b: Column) -> Column:
    """|a - b| <= ATOL + RTOL |b| for finite b, NaN equal to NaN, infinities to themselves."""
    near = (F.abs(a - b) <= ATOL + RTOL * F.abs(b)) & ~F.isnan(a) & ~F.isnan(b) & (F.abs(b) < float("inf"))
    return F.coalesce((a == b) | near, F.lit(False))


def _beside(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both sides by key, as a_ and b_ columns, with ``both_``: whether either side has the row."""
    x = a.select(*keys, F.lit(True).alias("in_a_"), *(F.col(c).alias(f"a_{c}") for c in columns))
    y = b.select(*keys, F.lit(True).alias("in_b_"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return x.join(y, keys, "full").withColumn("both_", F.col("in_a_").isNotNull() & F.col("in_b_").isNotNull())


def _long(joined: DataFrame, columns: list[str], kind: str | None = None) -> DataFrame:
    """(column, x, y, both_): a row for each row and column."""
    value = lambda c: F.col(c).cast(kind) if kind else F.col(c)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), value(f"a_{c}").alias("x"), value(f"b_{c}").alias("y")) for c in columns))
    return joined.select("both_", F.explode(rows).alias("r")).select("both_", "r.*")


def compare_columns(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, n, n_equal, max_residual, equal): exact comparison of numeric columns row by row, b - a as the residual. A row that one
    side lacks counts in n and is equal to nothing."""
    same = F.col("both_") & exact(F.col("x"), F.col("y"))
    rows = _long(_beside(a, b, keys, columns), columns, "double")
    return rows.groupBy("column").agg(F.count("*").alias("n"), F.sum(same.cast("long")).alias("n_equal"), F.max(F.abs(F.col("y") - F.col("x"))).alias("max_residual")).withColumn("equal", F.col("n") == F.col("n_equal"))


def compare_lists(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, status, n, n_bad): ok, rows differ (one side lacks some), lengths differ or values differ, for list columns; values may
    differ within tolerance. A list that is null equals a null one alone."""
    sized = F.coalesce(F.size("x"), F.lit(-1)) == F.coalesce(F.size("y"), F.lit(-1))
    equal = F.when(F.col("x").isNull() & F.col("y").isNull(), F.col("both_")).otherwise(F.coalesce(F.forall(F.zip_with("x", "y", close), lambda v: v), F.lit(False)) & sized)
    count = lambda c: F.sum(c.cast("long"))
    out = _long(_beside(a, b, [key], columns), columns).groupBy("column").agg(F.count("*").alias("n"), count(~F.col("both_")).alias("rows_"), count(~sized).alias("lengths"), count(~equal).alias("n_bad"))
    status = F.when(F.col("rows_") > 0, "rows differ").when(F.col("lengths") > 0, "lengths differ").when(F.col("n_bad") > 0, "values differ").otherwise("ok")
    return out.select("column", status.alias("status"), "n", "n_bad")


def compare_records(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(column, n, n_bad, status) for every other column: ok, rows differ (one side lacks some) or values differ; equal means identical,
    NaN to NaN and null to null; unequal schemas are an error."""
    if a.dtypes != b.dtypes:
        raise ValueError("the schemas differ")
    columns = [c for c in a.columns if c not in keys]
    bad = {c: F.sum((~(F.col("both_") & F.equal_null(F.col(f"a_{c}"), F.col(f"b_{c}")))).cast("long")).alias(c) for c in columns}
    flags = _beside(a, b, keys, columns).agg(F.count("*").alias("n"), F.coalesce(F.sum((~F.col("both_")).cast("long")), F.lit(0)).alias("rows_"), *bad.values())
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("n_bad")) for c in columns))
    status = F.when(F.col("rows_") > 0, "rows differ").when(F.col("r.n_bad") == 0, "ok").otherwise("values differ")
    return flags.select("n", "rows_", F.explode(rows).alias("r")).select("r.column", "n", "r.n_bad", status.alias("status"))


def report(compared: DataFrame) -> DataFrame:
    """(line, column, status, n, n_bad): the columns of a comparison by name, and a last line OVERALL: ok if every column is. A row for
    each column, so that one window numbers them."""
    whole = compared.agg(F.lit("OVERALL").alias("column"), F.when(F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)), "ok").otherwise("differs").alias("status"), F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_bad"), F.lit(0)).alias("n_bad"))
    rows = compared.select(F.lit(0).alias("last"), "column", "status", "n", "n_bad").unionByName(whole.select(F.lit(1).alias("last"), "*"))
    return rows.withColumn("line", F.row_number().over(Window.orderBy("last", "column"))).select("line", "column", "status", "n", "n_bad").orderBy("line")

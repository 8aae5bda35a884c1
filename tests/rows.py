"""Comparison of rows from different engines."""

import math

import numpy as np


def norm(v):
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def same(spark_df, con, sql):
    relation = con.sql(sql)
    columns = relation.columns
    assert sorted(columns) == sorted(spark_df.columns)
    order = sorted(columns)
    ours = sorted("|".join(norm(r[c]) for c in order) for r in spark_df.collect())
    theirs = sorted("|".join(norm(r[columns.index(c)]) for c in order) for r in relation.fetchall())
    assert ours == theirs

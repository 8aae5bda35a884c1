import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from octoweave.functions import scalars
from octoweave.operators import compare, counts, metrics, records, splits


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "split string, ctx int, byte int, n long, p double, rank int, pred int, conf double")


ROWS = [("a", 1, 1, 3, 0.5, 1, 1, 0.5), ("a", 1, 2, 1, 0.25, 2, 1, 0.5), ("a", 2, 2, 2, 1.0, 1, 2, 1.0), ("b", 3, 0, 1, 0.01, 7, 9, 0.0)]


def test_calibration_agrees_with_numpy(spark):
    edges = metrics.uniform_edges(4)
    got = {(r["split"], r["bin"]): r for r in metrics.calibration(outcomes(spark, ROWS), edges).collect()}
    conf = np.repeat([r[7] for r in ROWS], [r[3] for r in ROWS])
    place = np.clip(np.digitize(conf, edges, right=True) - 1, 0, 3)
    assert {k[1] for k in got} == set(place)
    assert got[("a", 1)]["n"] == 4 and got[("a", 1)]["acc"] == 0.75 and got[("b", 0)]["acc"] == 0
    ece = {r["split"]: r["ece"] for r in metrics.expected_error(metrics.calibration(outcomes(spark, ROWS), edges)).collect()}
    assert ece["a"] == pytest.approx((0.25 * 4 + 0) / 6)


@pytest.mark.parametrize("x, want", [(0.0, 0), (0.05, 0), (0.35, 6), (0.350001, 7), (1.0, 19)])
def test_bins_are_closed_above(spark, x, want):
    edges = [i / 20 for i in range(21)]
    assert spark.range(1).select(metrics.bin_of(F.lit(x), edges).alias("b")).first()["b"] == want
    assert want == max(0, int(np.digitize(x, edges, right=True)) - 1)


def test_quantile_edges_fall_back_to_uniform(spark):
    one = outcomes(spark, [ROWS[0]])
    assert metrics.quantile_edges(one, 4) == metrics.uniform_edges(4)
    assert metrics.quantile_edges(outcomes(spark, ROWS), 2) == np.unique(np.quantile([0.5] * 4 + [1.0] * 2 + [0.0], [0, 0.5, 1])).tolist()


def test_top_k_and_confusion(spark):
    o = outcomes(spark, ROWS)
    got = {r["k"]: r["accuracy"] for r in metrics.top_k(o, 3).collect()}
    assert got == {1: 5 / 7, 2: 6 / 7, 3: 6 / 7}
    c = metrics.confusion(o, ignore=0)
    assert {(r["y"], r["pred"]): r["n"] for r in c.collect()} == {(1, 1): 3, (2, 1): 1, (2, 2): 2}
    prf = {r["byte"]: r for r in metrics.per_class(metrics.confusion(o), 5).collect()}
    assert prf[1]["precision"] == 0.75 and prf[2]["recall"] == pytest.approx(2 / 3) and prf[0]["f1"] == 0
    share = metrics.normalised(metrics.confusion(o), 2, "true").groupBy("y").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in share)


def test_splits_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        splits.split_sizes(spark.createDataFrame([(10,)], "n_bytes long"), 2, 2, (0.5, 0.1, 0.1))
    row = splits.split_sizes(spark.createDataFrame([(103,)], "n_bytes long"), 5, 2).first()
    assert (row["usable"], row["n_train"], row["n_val"], row["n_test"]) == (100, 80, 10, 10)
    cut = spark.range(10).select(splits.cut_of(F.col("id"), F.lit(10)).alias("s")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in cut} == {"train": 8, "val": 1, "test": 1}


def test_bytes_outside_a_vocabulary_are_refused(spark):
    df = spark.createDataFrame([(b"abc",)], "data binary")
    assert counts.remapped(df, {97: 0, 98: 1, 99: 2}).first()["data"] == b"\0\1\2"
    with pytest.raises(Exception, match="outside the vocabulary"):
        counts.remapped(df, {97: 0, 98: 1}).collect()


def test_counts_take_nulls_and_empty_values(spark):
    df = spark.createDataFrame([(b"aab",), (None,), (b"",), (b"b",)], "data binary")
    assert {r["byte"]: r["n"] for r in counts.byte_counts(df).collect()} == {97: 2, 98: 2}
    assert {(r["ctx"], r["byte"]): r["n"] for r in counts.pair_counts(df).collect()} == {(97, 97): 1, (97, 98): 1}


def test_records_of_bytes(spark):
    m = np.arange(6, dtype="<f4").reshape(3, 2)
    df = spark.createDataFrame([(1, m.tobytes()), (2, b"")], "src_id long, data binary")
    got = records.flat_records(df, ["a", "b"]).orderBy("row").collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, 1), (2, 3), (4, 5)]
    bad = spark.createDataFrame([(1, m.tobytes() + b"x")], "src_id long, data binary")
    with pytest.raises(Exception, match="not whole rows"):
        records.flat_records(bad, ["a", "b"]).collect()
    assert records.flat_records(bad, ["a", "b"], exact=False).count() == 3


def test_jagged_rows_of_every_shape(spark):
    df = spark.createDataFrame([(1, 2.0, [1.0, 2.0], []), (2, None, [], None), (3, 1.0, None, [])], "id long, s double, v array<double>, w array<double>")
    scalar, lists = records.branches(df.schema)
    assert (scalar, lists) == (["id", "s"], ["v", "w"])
    meta = records.sidecar(df, ["s", "v", "w"])
    assert [b["max_len"] for b in meta["branches"]] == [1, 2, 0]
    back = {r["id"]: r for r in records.unpadded(records.padded(df, meta, "id"), meta, "id").collect()}
    assert back[1]["v"] == [1.0, 2.0] and back[2]["v"] == [] and back[2]["s"] == 0.0 and back[3]["w"] == []
    short = records.padded(df, meta, "id").withColumn("row", F.slice("row", 1, 2))
    with pytest.raises(Exception, match="wide"):
        records.unpadded(short, meta, "id").collect()
    assert records.padded(df.limit(0), records.sidecar(df.limit(0), ["s", "v"]), "id").count() == 0


def test_comparisons_treat_nan_as_they_should(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, nan, [nan, 1.0]), (2, 1.0, [1.0, 2.0])], "id long, x double, v array<double>")
    assert compare.compare_columns(a, a, ["id"], ["x"]).first()["equal"] is False
    assert {r["column"]: r["status"] for r in compare.compare_records(a, a, ["id"]).collect()} == {"x": "ok", "v": "ok"}
    b = a.withColumn("v", F.transform("v", lambda x: x + 1e-9))
    assert compare.compare_lists(a, b, "id", ["v"]).first()["status"] == "ok"
    c = a.withColumn("v", F.slice("v", 1, 1))
    assert compare.compare_lists(a, c, "id", ["v"]).first()["status"] == "lengths differ"
    with pytest.raises(ValueError):
        compare.compare_records(a, a.drop("x"), ["id"])


def test_comparisons_see_rows_that_one_side_lacks(spark):
    inf = float("inf")
    a = spark.createDataFrame([(i, float(i), [1.0, inf]) for i in range(5)], "id long, x double, v array<double>")
    b = a.where("id < 3").union(spark.createDataFrame([(9, 9.0, None)], a.schema))
    got = compare.compare_columns(a, b, ["id"], ["x"]).first()
    assert (got["n"], got["n_equal"], got["equal"]) == (6, 3, False)
    assert compare.compare_lists(a, b, "id", ["v"]).first()[:] == ("v", "rows differ", 6, 3)
    assert {tuple(r) for r in compare.compare_records(a, b, ["id"]).collect()} == {("x", 6, 3, "rows differ"), ("v", 6, 3, "rows differ")}
    assert [tuple(r)[:3] for r in compare.report(compare.compare_records(a, a, ["id"])).collect()] == [(1, "v", "ok"), (2, "x", "ok"), (3, "OVERALL", "ok")]
    pairs = spark.createDataFrame([(1.0, inf), (inf, 1.0), (inf, inf), (-inf, inf), (1.0, 1.0 + 1e-9), (None, 1.0)], "a double, b double")
    assert [r[0] for r in pairs.select(compare.close(F.col("a"), F.col("b"))).collect()] == [False, False, True, False, True, False]
    assert compare.compare_records(a.limit(0), a.limit(0), ["id"]).count() == 2


def test_a_vocabulary_rejects_what_it_lacks(spark):
    have = counts.byte_counts(spark.createDataFrame([(b"ab",)], "data binary")).select("byte")
    seen = counts.byte_counts(spark.createDataFrame([(b"abz",)], "data binary")).select("byte")
    assert [r["byte"] for r in seen.join(have, "byte", "left_anti").collect()] == [ord("z")]


def test_less_than_one_row_is_an_error_where_parts_are_dropped(spark):
    df = spark.createDataFrame([(1, b"abc")], "src_id long, data binary")
    with pytest.raises(Exception, match="less than one row"):
        records.flat_records(df, ["a"], exact=False).collect()


def test_the_first_difference_is_found_wherever_it_is(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i, n in enumerate([1, 2, 3, 7, 8, 9, 64, 1000, 1023, 1024, 1025, 3_000_000]):
        a = rng.integers(0, 3, n).astype(np.uint8)
        for at in {0, n // 2, n - 1}:
            b = a.copy()
            b[at:] = rng.integers(0, 3, n - at)
            b[at] = 255 - a[at]
            rows.append((100 * i + len(rows), a.tobytes(), b.tobytes(), at))
    rows += [(-1, b"same", b"same", None), (-2, b"long", b"longer", None), (-3, None, b"", None), (-4, None, b"x", None)]
    df = spark.createDataFrame(rows, "id long, a binary, b binary, at int")
    started = time.monotonic()
    got = compare.verify_bytes(df.select("id", F.col("a").alias("data")), df.select("id", F.col("b").alias("data")), "id")
    assert {r["id"]: r["first_diff"] for r in got.collect()} == {r[0]: r[3] for r in rows} and time.monotonic() - started < 30
    assert dict(got.dtypes)["first_diff"] == "bigint"


def peak_bytes(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


class Rows:
    """Stands for a table: hands back what would run over its batches."""

    schema = None

    def mapInArrow(self, run, schema):
        return run


def test_what_counting_and_replacing_need_does_not_grow_with_the_batch():
    rng = np.random.default_rng(6)
    values = [rng.integers(0, 200, n).astype(np.uint8).tobytes() for n in [0, 40_000, 0, 1, 3_000_000, *[40_000] * 300, 0]]
    batch = pa.record_batch({"id": pa.array(range(len(values))), "data": pa.array(values, pa.binary())})
    remap = counts.remapped(Rows(), {b: (b + 1) % 256 for b in range(256)})
    back = counts.remapped(Rows(), {(b + 1) % 256: b for b in range(256)})
    got = [(i, d) for piece in back(remap([batch])) for i, d in zip(piece["id"].to_pylist(), piece["data"].to_pylist())]
    assert got == list(enumerate(values))
    assert peak_bytes(lambda: [None for _ in remap([batch])]) < batch.nbytes
    for pairs in (False, True):
        assert peak_bytes(lambda: list(counts._counted(batch, "data", (), pairs))) < 3 * batch.nbytes
    (rows,) = counts._counted(batch, "data", (), True)
    want = np.zeros(65536, np.int64)
    for v in values:
        v = np.frombuffer(v, np.uint8).astype(np.int64)
        want += np.bincount(v[:-1] * 256 + v[1:], minlength=65536)
    assert {(c, b): n for c, b, n in zip(*(rows[k].to_pylist() for k in ("ctx", "byte", "n")))} == {(i // 256, i % 256): n for i, n in enumerate(want.tolist()) if n}


def test_softmax_takes_long_arrays(spark):
    v = np.random.default_rng(7).normal(size=1500)
    df = spark.createDataFrame([(1, v.tolist()), (2, [5.0]), (3, []), (4, None)], "id long, v array<double>")
    started = time.monotonic()
    got = {r["id"]: r["p"] for r in df.select("id", scalars.softmax(F.col("v")).alias("p")).collect()}
    e = np.exp(v - v.max())
    assert np.allclose(got[1], e / e.sum(), rtol=1e-12) and got[2] == [1.0] and got[3] == [] and got[4] is None
    assert time.monotonic() - started < 20

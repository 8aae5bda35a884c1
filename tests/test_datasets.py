import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from octoweave.operators.records import unpadded
from octoweave.plans import ssm, training
from octoweave.sources import datasets as D


def test_dtype_descriptions_and_schemas():
    schema = D.schema_of_descr('[["pt", "<f4"], ["n", "<i8"], ["hits", "<f8", [3]]]')
    assert [f.dataType.simpleString() for f in schema] == ["float", "bigint", "array<double>"]
    flat = T.StructType(schema.fields[:2])
    assert D.schema_of_descr(D.descr_of_schema(flat)) == flat
    assert D.schema_of_descr(D.descr_of_schema(schema)) == schema and json.loads(D.descr_of_schema(schema))[2] == ["hits", "<f8", [3]]
    assert json.loads(D.descr_of_schema(T.StructType().add("v", T.ArrayType(T.ArrayType(T.FloatType()))))) == [["v", "<f4", [-1, -1]]]


def test_events_with_their_sidecar(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, [1.0]), (2, 3.0, [])], "id long, s double, v array<double>")
    meta = D.write_events(df, ["s", "v"], "id", str(tmp_path))
    rows, again = D.read_events(spark, str(tmp_path))
    assert again == meta and sorted(map(tuple, unpadded(rows, again, "id").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_columns_that_there_are(spark):
    df = spark.createDataFrame([([7.0, 8.0], 1.0)], "metal array<double>, x double")
    assert D.present(df, ["x", "y", "metal"]).first().asDict() == {"x": 1.0, "metal": 7.0}
    assert df.select(D.stacked([F.col("x"), F.col("x")]).alias("a")).first()["a"] == [1.0, 1.0]


def test_prefixes_and_flat_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(bytes(range(100)))
    assert D.copy_prefix(str(tmp_path / "a"), str(tmp_path / "b"), 30, 7) == 30 and (tmp_path / "b").read_bytes() == bytes(range(30))
    df = spark.createDataFrame([(2, [3.0]), (1, [1.0, 2.0])], "id long, v array<float>")
    assert D.write_binary(df, "v", "id", str(tmp_path / "c")) == 12
    assert np.fromfile(tmp_path / "c", "<f4").tolist() == [1, 2, 3]


def test_archives_stay_in_their_folder(tmp_path):
    def archive(name, member):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            info = tarfile.TarInfo(member)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
        return str(tmp_path / name)

    paths = D.extract(archive("ok.tgz", "x/events.hepmc"), str(tmp_path / "out"))
    assert D.chosen(paths) == os.path.join(str(tmp_path / "out"), "x/events.hepmc")
    with pytest.raises(ValueError):
        D.extract(archive("bad.tgz", "../../evil"), str(tmp_path / "out"))
    assert D.chosen([str(tmp_path / "ok.tgz")], (".none",)) == str(tmp_path / "ok.tgz")


def test_turbulence_and_its_scale(spark):
    df = D.turbulence(spark, 8)
    wide = df.groupBy("cell").pivot("field", ["u", "v", "w", "p"]).agg(F.first("value"))
    out = D.normalised(wide, {"u": 0.5, "p": 1.0}).agg(F.stddev_pop("u").alias("u"), F.stddev_pop("p").alias("p"), F.count("*").alias("n")).first()
    assert out["n"] == 512 and out["u"] == pytest.approx(0.5, rel=1e-4) and out["p"] == pytest.approx(1.0, rel=1e-4)


def test_the_output_layer_learns(spark):
    df = spark.createDataFrame([(b"abababababababab",), (b"babababab",), (None,), (b"a",)], "data binary")
    model = ssm.StateSpace(ssm.random_weights(16, 1, 256, seed=1), 16, 1)
    fitted, curve = training.fit_head(df, model, epochs=4, rate=1.0)
    assert curve[-1] < curve[0] and fitted.fingerprint != model.fingerprint


def test_the_reproducible_exponential():
    x = np.linspace(-80, 80, 4001, dtype=np.float32).astype(np.float64)
    assert np.allclose(ssm.reproducible_exp(x), np.exp(x), rtol=3e-6)

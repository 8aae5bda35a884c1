import json

import pytest

from octoweave import cli


def test_the_whole_way(spark, tmp_path):
    data = b"".join(b"line %d of the file\n" % i for i in range(4000))
    (tmp_path / "in.bin").write_bytes(data)
    out = str(tmp_path / "out")
    said = cli.main([str(tmp_path / "in.bin"), out, "--chunk-size", "1000", "--verify", "--evaluate", "--show-timings"], spark)
    assert said["verified"] and said["ratio"] > 1.5 and (tmp_path / "out/decoded.bin").read_bytes() == data
    assert set(said["bits_per_byte"]) == {"train", "val", "test"} and set(said["seconds"]) >= {"train", "compress", "decompress"}
    (tmp_path / "out/decoded.bin").unlink()
    cli.main([str(tmp_path / "in.bin"), out, "--chunk-size", "1000", "--decompress-only"], spark)
    assert (tmp_path / "out/decoded.bin").read_bytes() == data
    base = cli.main([str(tmp_path / "in.bin"), out, "--comparison-baseline-only"], spark)["baselines"]
    assert {r["codec"] for r in base} == {"zlib", "lzma"}


def test_a_configuration_names_the_file(spark, tmp_path, monkeypatch):
    (tmp_path / "in.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "c.yaml").write_text(json.dumps({"file_path": str(tmp_path / "in.bin"), "compression": {"seq_size": 500}}))
    monkeypatch.chdir(tmp_path)
    said = cli.main(["--config", str(tmp_path / "c.yaml"), "--train-only"], spark)
    assert "ratio" not in said


def test_bad_inputs_fail_fast(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cli.main([str(tmp_path / "none"), str(tmp_path)], spark)
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(ValueError):
        cli.main([str(tmp_path / "empty"), str(tmp_path)], spark)
    (tmp_path / "x").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        cli.main([str(tmp_path / "x"), str(tmp_path), "--model-path", "/nowhere"], spark)

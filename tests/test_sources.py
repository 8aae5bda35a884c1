import json
import struct

import numpy as np
import pytest

from octoweave.functions import scalars as S
from octoweave.operators import chunks
from octoweave.plans import codec
from octoweave.plans.predictor import CountModel, train_counts
from octoweave.sources import config, container, ranges


def written(tmp_path, streams=((1, b"abcd"), (2, b""), (3, b"x" * 8))):
    path = str(tmp_path / "one.owc")
    container.write_file(path, container.Meta(25, 10, len(streams), 5, b"f" * 16), streams)
    return path


def test_container_keeps_header_and_index(tmp_path):
    m = container.read_meta(written(tmp_path))
    assert (m.uncompressed, m.chunk_len, m.n_chunks, m.last_chunk_len, m.fingerprint) == (25, 10, 3, 5, b"f" * 16)
    assert (m.first, m.sizes, m.offsets) == ([1, 2, 3], [4, 0, 8], [0, 4, 4])


def test_marks_among_first_bytes_do_not_mislead(tmp_path):
    path = str(tmp_path / "m.owc")
    first = list(b"xIDX1IDX1y")
    container.write_file(path, container.Meta(10, 1, 10, 1), [(b, b"IDX1") for b in first])
    assert container.read_meta(path).first == first


@pytest.mark.parametrize("damage, said", [
    (lambda b: b"NOPE" + b[4:], "magic"), (lambda b: b[:4] + struct.pack("<I", 9) + b[8:], "version"), (lambda b: b[:-1] + bytes([b[-1] ^ 1]), "check value"),
    (lambda b: b[:50], "index is missing|check value|magic"), (lambda b: b[:3], "magic"), (lambda b: b.replace(b"IDX1", b"IDY1"), "missing"),
])
def test_damage_is_named(tmp_path, damage, said):
    path = written(tmp_path)
    data = open(path, "rb").read()
    open(path, "wb").write(damage(data))
    with pytest.raises(container.ContainerError, match=said):
        container.read_meta(path)


def test_ranges_past_the_payload_are_refused(tmp_path):
    path = str(tmp_path / "r.owc")
    with open(path, "wb") as f:
        f.write(container.header(container.Meta(4, 4, 1, 4)) + b"ab" + container.index([1], [99]))
    with pytest.raises(container.ContainerError, match="passes"):
        container.read_meta(path)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(2)
    return bytes(rng.choice(list(b"the quick brown fox "), 10_007).astype(np.uint8))


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_container_is_the_same_for_any_partitioning(spark, tmp_path, corpus, parts):
    rows = [(i, corpus[i * 100 : i * 100 + 100]) for i in range(101)]
    df = spark.createDataFrame(rows, "chunk_id int, data binary").repartition(parts)
    model = train_counts(df)
    path = str(tmp_path / "c")
    container.save(codec.compress(container.ranged(df, 1), model), path, 100, model.fingerprint)
    back = codec.decompress(container.load(spark, path, fingerprint=model.fingerprint.hex()), model).orderBy("chunk_id").collect()
    assert b"".join(bytes(r["data"]) for r in back) == corpus
    some = container.load(spark, path, chunks="3,99").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in some] == [3, 99]
    meta = container.metadata(spark, path).first()
    assert (meta["uncompressed_len"], meta["n_chunks"], meta["last_chunk_len"]) == (len(corpus), 101, 7)
    files = sorted((tmp_path / "c").glob("*.owc"))
    if not hasattr(test_container_is_the_same_for_any_partitioning, "seen"):
        test_container_is_the_same_for_any_partitioning.seen = files[0].read_bytes()
    assert files[0].read_bytes() == test_container_is_the_same_for_any_partitioning.seen
    with pytest.raises(Exception, match="model is not the one"):
        container.load(spark, path, fingerprint="00").collect()


def test_byte_ranges_read_files_in_pieces(spark, tmp_path, corpus):
    (tmp_path / "a.bin").write_bytes(corpus)
    df = ranges.chunks_of(spark, str(tmp_path / "a.bin"), 1000, chunksPerTask=3)
    got = sorted(df.collect(), key=lambda r: r["chunk_id"])
    assert b"".join(bytes(r["data"]) for r in got) == corpus and len(got) == 11
    assert ranges.chunks_of(spark, str(tmp_path / "a.bin"), 1000, maxChunks=2).count() == 2
    assert ranges.whole_files(spark, str(tmp_path / "a.bin")).first()["data"] == corpus


def test_models_keep_their_counts_and_names():
    m = CountModel(np.arange(256 * 256).reshape(256, 256))
    assert CountModel.from_bytes(m.to_bytes()).fingerprint == m.fingerprint


def test_config_precedence_and_resolution(tmp_path):
    folder = tmp_path / "experiments" / "e"
    folder.mkdir(parents=True)
    (folder / "e.yaml").write_text(json.dumps({"name": "e", "device": "gpu", "splits": [1, 2], "model": {"d_model": 8}}))
    path = config.resolve("e", str(tmp_path))
    c = config.load(path, device="cpu")
    assert (c.device, c.d_model, c.splits) == ("cpu", 8, [0.8, 0.1, 0.1])
    with pytest.raises(FileNotFoundError):
        config.resolve("none", str(tmp_path))
    (folder / "e.yaml").write_text(json.dumps({"model_path": "/nowhere/model"}))
    with pytest.raises(FileNotFoundError):
        config.load(path)
    assert config.latest_checkpoint(["a_epoch2.pt", "a_epoch10.pt", "b.pt"]) == "a_epoch10.pt"


@pytest.mark.parametrize("x", [0, 127, 128, 16383, 16384, 2**40])
def test_varints(spark, x):
    from pyspark.sql import functions as F

    data = S.uvarint(x)
    assert S.read_uvarint(b"z" + data, 1) == (x, 1 + len(data))
    assert spark.range(1).select(S.uvarint_length(F.lit(x)).alias("n")).first()["n"] == len(data)


@pytest.mark.parametrize("n", [1, 9, 10, 11, 20])
def test_chunk_plans_cover_every_byte_once(spark, n):
    sized = spark.createDataFrame([(n,)], "n_bytes long")
    for kw in ({"seq_size": 10}, {"chunks": 7}):
        rows = chunks.chunk_ranges(chunks.chunk_plan(sized, **kw)).orderBy("chunk_id").collect()
        assert sum(r["chunk_bytes"] for r in rows) == n and all(r["chunk_bytes"] > 0 for r in rows)
    with pytest.raises(ValueError):
        chunks.chunk_plan(sized)


def test_empty_sources_are_an_error(spark):
    with pytest.raises(Exception, match="empty source"):
        chunks.chunk_plan(spark.createDataFrame([(0,)], "n_bytes long"), seq_size=3).collect()


@pytest.mark.parametrize("marked", [True, False])
def test_streams_lose_and_repeat_no_byte(spark, tmp_path, marked):
    from octoweave.streaming.chunks import compress_stream

    rows = [(f"s{i % 3}", i, f"value {i} ".encode() if i < 300 else None, i >= 300) for i in range(303)] + [("tiny", 0, b"x", True)]
    schema = "src_id string, seq long, data binary, end boolean"
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model = CountModel(np.ones((1, 256), np.int64))
    compress_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "state"), 64, end="end" if marked else None).awaitTermination()
    out = codec.decompress(spark.read.parquet(str(tmp_path / "out")), model).collect()
    for s in {r[0] for r in rows}:
        whole = b"".join(v or b"" for k, _, v, _ in rows if k == s)
        got = sorted((r["chunk_id"], bytes(r["data"])) for r in out if r["src_id"] == s)
        assert [i for i, _ in got] == list(range(len(got)))
        assert b"".join(v for _, v in got) == (whole if marked else whole[: len(whole) // 64 * 64])


def test_silent_sources_give_their_tail_after_a_while(spark, tmp_path):
    import time

    from octoweave.streaming.chunks import compress_stream

    spark.createDataFrame([("a", 0, b"tail")], "src_id string, seq long, data binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src_id string, seq long, data binary").parquet(str(tmp_path / "in"))
    model = CountModel(np.ones((1, 256), np.int64))
    q = compress_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "state"), 64, once=False, idle=1000)
    try:
        for _ in range(60):
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists() and (rows := spark.read.schema("chunk_id long, n int").parquet(str(tmp_path / "out")).collect()):
                break
    finally:
        q.stop()
    assert [(r["chunk_id"], r["n"]) for r in rows] == [(0, 4)]


def test_containers_and_ranges_take_uris_and_overwrite(spark, tmp_path, corpus):
    rows = [(i, corpus[i * 1000 : i * 1000 + 1000]) for i in range(11)]
    df, path = spark.createDataFrame(rows, "chunk_id long, data binary"), f"file://{tmp_path}/c"
    model = train_counts(df)
    small = codec.compress(container.ranged(df, 3), model)
    container.save(small, path, 1000, model.fingerprint)
    container.save(small, path, 1000, model.fingerprint, mode="overwrite")
    back = codec.decompress(container.load(spark, path, chunksPerTask=2), model).orderBy("chunk_id").collect()
    assert b"".join(bytes(r["data"]) for r in back) == corpus and [r["chunk_id"] for r in back] == list(range(11))
    assert not [f for f in (tmp_path / "c").iterdir() if "tmp" in f.name]
    (tmp_path / "a.bin").write_bytes(corpus)
    assert b"".join(bytes(r["data"]) for r in ranges.chunks_of(spark, f"file://{tmp_path}/a.bin", 1000).orderBy("chunk_id").collect()) == corpus
    with pytest.raises(Exception, match="sort chunk rows"):
        container.save(codec.compress(df.orderBy(df.chunk_id.desc()).coalesce(1), model), path, 1000)


def test_lanes_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(codec, "TABLE_BYTES", 8000)
    sizes = np.array([100, 1, 2, 900, 5, 0, 3000, 4] + [1] * 5000)
    runs = list(codec.lane_runs(sizes))
    assert [a for a, _ in runs] == np.r_[0, np.cumsum([n for _, n in runs])][:-1].tolist() and sum(n for _, n in runs) == len(sizes)
    assert all(n == 1 or n <= codec.LANES and sizes[a : a + n].max() * n * 8 <= 8000 for a, n in runs)

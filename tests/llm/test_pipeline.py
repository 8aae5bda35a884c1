import corpus_pipeline as pipeline
import pytest

from octoweave.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, out = table(spark, sf_dir, "documents"), []
    base = tmp_path_factory.mktemp("pipeline")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(base / name))
        out.append((name, docs, docs := spark.read.parquet(str(base / name))))
    return out


def test_stages_keep_the_columns_and_only_lose_rows(steps, spark, sf_dir):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_dedup", "decontaminate", "mix"]
    columns = table(spark, sf_dir, "documents").columns
    for name, before, after in steps[:-1]:
        assert after.columns == columns
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    assert steps[-1][2].columns == [*columns, "size", "source_size", "target", "taken"]


def test_decisions_are_those_of_the_operators(steps, spark, sf_dir):
    from octoweave.llm import dartminhash, decontaminate, quality

    by = {name: (before, after) for name, before, after in steps}
    before, after = by["quality"]
    good = {r["doc_id"] for r in quality.quality(before, table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    assert good == {r["doc_id"] for r in after.collect()}
    before, after = by["near_dedup"]
    assert {r["class_id"] for r in dartminhash.near_dedup(before).collect()} == {r["doc_id"] for r in after.collect()}
    before, after = by["decontaminate"]
    leaked = {r["doc_id"] for r in decontaminate.leaks(before, table(spark, sf_dir, "benchmark")).collect()}
    assert leaked and {r["doc_id"] for r in before.collect()} - leaked == {r["doc_id"] for r in after.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in by["lines"][1].collect())
    assert all(r["taken"] > 0 for r in steps[-1][2].collect())


def test_run_gives_the_last_stage(steps, spark, sf_dir):
    got = sorted(map(str, pipeline.run(spark, sf_dir).collect()))
    assert got == sorted(map(str, steps[-1][2].collect()))


@pytest.mark.parametrize("n", [0, 1])
def test_stages_take_awkward_rows_and_empty_tables(spark, tmp_path, n):
    from pyspark.sql import functions as F

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 5), (2, text, None, "b", None), (2, text, None, "b", None), (None, text + " more", "en", None, 1), (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, "x\ny\nz\nw " * 4000, "en", "c", 9), (6, "line one\nline two\nline three\n" * 3, "de", "a", 2)]
    docs = spark.createDataFrame(rows * n, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("size", "target", "class_id", "row_", "id_", "k_", "key", "n_lines_", "gone", "text_"):
        docs = docs.withColumn(name, F.lit("x"))
    spark.createDataFrame([(1, 1, None), (None, 0, 1), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, "word1 word2 word3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        ids[name] = {r["doc_id"] for r in docs.collect()}
        if name != "mix":
            assert docs.columns == columns
    assert docs.columns[-4:] == ["size", "source_size", "target", "taken"]
    if n:
        assert ids["lines"] == {1, 2, 3, 4, 5, 6, None} and ids["near_dedup"] == ids["lines"] - {2}
        assert ids["decontaminate"] == {3, 4, 5, 6}  # the others hold the benchmark's item of three words whole
        assert 3 not in ids["mix"] and 4 not in ids["mix"]
    else:
        assert not any(ids.values())

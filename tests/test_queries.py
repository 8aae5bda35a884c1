import ast
import pathlib

import pytest
from rows import same

from octoweave import queries as core

ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, name):
    same(core.QUERIES[name](spark, sf_dir), duck, core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_registers_the_core_queries(spark):
    import __spark_entry__ as entry

    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_optional_operators():
    for path in (ROOT / "octoweave").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_compressed_sizes_beat_deflate_per_document(spark, sf_dir):
    ours = core.QUERIES["compression_ratio"](spark, sf_dir).first()["ratio"]
    zlib = {r["codec"]: r["ratio"] for r in core.QUERIES["baseline_zlib_lzma"](spark, sf_dir).collect()}
    assert ours > 2 and zlib["zlib"] > 1


@pytest.mark.parametrize("name, columns", [("byte_histogram", {"text"}), ("entropy_order0_by_lang", {"text", "lang"}), ("chunk_lengths", {"doc_id", "text"}), ("sanitize_names", {"page_id", "url"}), ("column_histogram", {"embedding"})])
def test_scans_read_only_their_columns(spark, sf_dir, name, columns):
    import re

    plan = core.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|,|$)", plan) for c in re.findall(r"\w+:", schema)}
    assert read and {c.rstrip(":") for c in read} <= columns | {"vec_id"}, plan


def test_queries_without_sql_agree_with_plain_loops(spark, sf_dir):
    import lzma
    import zlib

    from octoweave.operators import baselines

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert {r["page_id"]: r["crc"] for r in core.chunk_crc32(spark, sf_dir).collect()} == {r["page_id"]: zlib.crc32(r["html"].encode()) for r in pages}
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["text"]}
    small = {r["doc_id"]: r for r in core.compress_sizes(spark, sf_dir).collect()}
    assert {k: v["original"] for k, v in small.items()} == {k: len(v) for k, v in texts.items()}
    total = core.compression_ratio(spark, sf_dir).first()
    assert total["compressed"] == sum(r["compressed"] for r in small.values()) and total["ratio"] == total["original"] / total["compressed"]
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    files = core.container_metadata(spark, sf_dir).collect()
    assert sum(r["n_chunks"] for r in files) == len(vectors) and sum(r["uncompressed_len"] for r in files) == sum(4 * len(r["embedding"]) for r in vectors)
    sizes = {r["codec"]: r["compressed"] for r in core.baseline_zlib_lzma(spark, sf_dir).collect()}
    assert sizes["zlib"] == sum(len(zlib.compress(t, 9)) for t in texts.values())
    some = [texts[k] for k in sorted(texts)[:20]] + [b"", b"x", b"abc" * 5000]
    assert all(len(baselines.CODECS["lzma"](t)) == len(lzma.compress(t, preset=9 | lzma.PRESET_EXTREME)) for t in some)

"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. quality: documents that the fitted classifier rejects go.
2. lines: repeated lines go from the texts; a text that loses all its words stays, empty.
3. near_dedup: of each group of near-duplicate documents the one of smallest doc_id stays.
4. decontaminate: documents that hold a benchmark item go.
5. mix: documents of which the mix takes words stay, with how many.

Stages return the columns of documents; the last adds size, source_size, target and taken, in place of any of these names. ``n_chars``
follows the text. Without labelled rows of both classes the first stage keeps everything. Null texts count as empty and a null doc_id is
in no group of near duplicates; rows that share a doc_id are one document there and stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octoweave.llm.common import delete, scratch, shared_dir, table
from octoweave.llm.dartminhash import near_dedup
from octoweave.llm.decontaminate import clean
from octoweave.llm.line_dedup import line_dedup
from octoweave.llm.mixing import mix
from octoweave.llm.quality import fit, kept


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest, fitted = fit(docs, table(spark, sf_dir, "labels"))
    return kept(docs, forest) if fitted else docs


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = near_dedup(docs).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(others.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ["size", "source_size", "target", "taken"]
    return mix(docs, carry=True).where("taken > 0").select(*(f"`{c}`" for c in docs.columns if c not in own), *own)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", leak_stage),
    ("mix", mix_stage),
]

#: The first stage is a fitted model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each by way of a table in the cluster's shared folder; a stage's own tables go when it is
    written, and its result when the next one is."""
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
        if before:
            delete(spark, f"{base}/{before}")
        before = name
    return docs

"""Removal of repeated lines by overlapping three-line windows, in DataFrame functions only.

Lines that are not blank are numbered within their document; each three consecutive ones are a window, known by two 64-bit hashes of
its trimmed lines. A window's first occurrence in the corpus is the one in the smallest document, then the smallest place; every
later occurrence covers its three lines, and covered lines go, overlaps merged. First occurrences come from a partial aggregation
before the shuffle, later ones from a join with the repeated windows alone. Those are written first: a join straight onto an aggregation
by the same key could not be split by adaptive execution where a window is hot.

Defined results: documents order by doc_id, null last, then by a hash of the text; rows equal in both are one occurrence and lose the
same lines; null text counts as empty and stays null if nothing goes; blank lines are in no window and stay; texts of fewer than three
lines that are not blank stay whole; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

LINES = 3


def _lines(text: str) -> F.Column:
    """The lines that are not blank: (line, from 0; trimmed content)."""
    numbered = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("content")))
    return F.filter(numbered, lambda x: x["content"] != "")


def _windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, at): hashes of each window, and where it stands; at orders occurrences."""
    found = docs.select("id_", "k_", _lines("text_").alias("l")).where(F.size("l") >= LINES)
    found = found.select("id_", "k_", "l", F.explode(F.sequence(F.lit(0), F.size("l") - LINES)).alias("p"))
    rows = [F.element_at("l", F.col("p") + i + 1) for i in range(LINES)]
    hashes = [F.xxhash64(F.lit(salt), *(r["content"] for r in rows)).alias(f"h{salt}") for salt in (1, 2)]
    at = F.struct(F.col("id_").isNull().alias("last"), F.col("id_").alias("id"), F.col("k_").alias("k"), F.col("p").alias("p"))
    return found.select(*hashes, at.alias("at"), F.array(*(r["line"] for r in rows)).alias("covered"))


def covered_lines(docs: DataFrame) -> DataFrame:
    """(id_, k_, gone): the numbers of the lines that go, for each document that loses some."""
    windows = _windows(docs)
    repeated = materialise(windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    later = windows.join(repeated, ["h1", "h2"]).where("at > first")
    return later.groupBy(F.col("at.id").alias("id_"), F.col("at.k").alias("k_")).agg(F.array_distinct(F.flatten(F.collect_set("covered"))).alias("gone"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their text cut, and n_lines_, n_removed_: lines that are not blank, and how many of them went."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("k_"))
    gone = covered_lines(docs.select(F.col("doc_id").alias("id_"), F.xxhash64("text").alias("k_"), F.col("text").alias("text_"))).withColumnsRenamed({"id_": "id__", "k_": "k__"})
    joined = keyed.join(gone.hint("merge"), F.col("id_").eqNullSafe(F.col("id__")) & (F.col("k_") == F.col("k__")), "left")
    cut = F.array_join(F.filter(F.split("row_.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row_.text")).otherwise(cut).alias("text")
    kept = [text if c == "text" else F.col(f"row_.`{c}`") for c in docs.columns if c not in ("n_lines_", "n_removed_")]
    return joined.select(*kept, F.size(_lines("row_.text")).alias("n_lines_"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed_"))

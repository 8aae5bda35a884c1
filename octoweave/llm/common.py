"""What the operators share: tables, the cluster's shared folder, and linked groups."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir; a temporary one only where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="octoweave-"))
            at = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = at.get()
    return named.rstrip("/")


#: Folders that hold what is written within ``scratch``, innermost last.
_scratch: list[str] = []


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """What ``materialise`` writes within goes when it ends, so results must be written elsewhere before."""
    _scratch.append(f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete(spark, _scratch.pop())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads them back: lineage ends there, and a lost executor loses nothing."""
    path = f"{_scratch[-1] if _scratch else shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*written: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote and nothing reads any more."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(n_bytes: float, each: float, least: int = 16) -> int:
    """How many buckets keep each at about ``each`` bytes."""
    return max(least, int(-(-n_bytes // each)))


def _edge_state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, class_id) for each node of the links a-b; class_id is the smallest node of its connected group.

    Alternating large-star and small-star steps, each an aggregation and a join whose skew adaptive execution splits; every round
    is written to the shared folder. A star around one hub stays linear: no step pairs the hub's neighbours. Least neighbours are
    written before they are joined: a join straight onto an aggregation by the same key could not be split where a key is hot.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    state = _edge_state(edges)
    while state[0]:
        start = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        edges = both.join(large, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialise(edges, "edges")
        low = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        kept = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialise(kept.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(start, large, old, low)
        new = _edge_state(edges)
        if new == state:
            break
        state = new
    low = edges.groupBy("u").agg(F.min("v").alias("class_id")).withColumnRenamed("u", "node")
    return low.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class_id")).distinct())


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels nothing may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int) -> DataFrame:
    """doc_id, text, label_ of at most ``rows`` labelled documents that are not held out and have ``max_bytes`` of text at most: those
    of the least hashed doc_id, so that the sample is the same on every run; of rows that share a doc_id the least text. Labels of
    documents that are not there take no place. It bounds what a model is fitted on, and nothing else."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("id_")).agg(F.max(label).cast("int").alias("label_"))
    fit = docs.select(F.col("doc_id").alias("id_"), "text").where(F.octet_length("text") <= max_bytes)
    some = known.join(fit.select("id_"), "id_", "left_semi").orderBy(F.xxhash64("id_"), "id_").limit(rows)
    got = fit.join(F.broadcast(some), "id_")  # a row for each sampled label: at most ``rows``
    return got.groupBy(F.col("id_").alias("doc_id")).agg(F.min("text").alias("text"), F.max("label_").alias("label_"))

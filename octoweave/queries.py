"""The registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import baselines, chunks, compare, counts, index, metrics, records, recurrent, splits
from .plans import codec
from .plans.coder import TOTAL
from .plans.predictor import train_counts
from .session import shared_dir
from .sources import container, datasets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEQ, BATCH, CHUNK = 16, 2, 1000

#: Bytes of the documents in DuckDB: doc_id, pos, byte.
BYTES = "h AS (SELECT doc_id, lang, strlen(text) AS n_bytes, regexp_extract_all(hex(encode(text)), '..') AS v FROM documents WHERE strlen(text) > 0), b AS (SELECT doc_id, lang, n_bytes, pos, CAST('0x' || x AS INT) AS byte FROM (SELECT doc_id, lang, n_bytes, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM h))"
SIZES = f"z AS (SELECT *, (n_bytes // {SEQ * BATCH}) * {SEQ * BATCH} AS usable FROM (SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) > 0)), y AS (SELECT *, (CAST(floor(usable * 0.8::DOUBLE) AS BIGINT) // {SEQ * BATCH}) * {SEQ * BATCH} AS n_train, (CAST(floor(usable * 0.1::DOUBLE) AS BIGINT) // {SEQ * BATCH}) * {SEQ * BATCH} AS n_val FROM z), s AS (SELECT *, ((usable - n_train - n_val) // {SEQ * BATCH}) * {SEQ * BATCH} AS n_test FROM y)"
SPLIT_BYTES = f"{BYTES}, {SIZES}, sb AS (SELECT b.doc_id, b.pos, b.byte, CASE WHEN pos < n_train THEN 'train' WHEN pos < n_train + n_val THEN 'val' WHEN pos < n_train + n_val + n_test THEN 'test' END AS split FROM b JOIN s USING (doc_id))"
PAIRS = f"{SPLIT_BYTES}, pr AS (SELECT split, lag(byte) OVER (PARTITION BY doc_id, split ORDER BY pos) AS ctx, byte FROM sb WHERE split IS NOT NULL), pc AS (SELECT split, ctx, byte, count(*) AS n FROM pr WHERE ctx IS NOT NULL GROUP BY ALL)"
MODEL = f"{PAIRS}, g AS (SELECT ctx, CAST(r AS INT) AS byte FROM (SELECT DISTINCT ctx FROM pc WHERE split = 'train'), range(256) t(r)), m AS (SELECT g.ctx, g.byte, coalesce(n, 0) + 1 AS c FROM g LEFT JOIN pc ON pc.split = 'train' AND pc.ctx = g.ctx AND pc.byte = g.byte), mm AS (SELECT *, c / CAST(sum(c) OVER (PARTITION BY ctx) AS DOUBLE) AS p, row_number() OVER (PARTITION BY ctx ORDER BY c DESC, byte) AS rk FROM m), o AS (SELECT pc.split, pc.ctx, pc.byte, pc.n, coalesce(mm.p, 1.0::DOUBLE / 256) AS p, coalesce(mm.rk, pc.byte + 1) AS rk, coalesce(t.byte, 0) AS pred, coalesce(t.p, 1.0::DOUBLE / 256) AS conf FROM pc LEFT JOIN mm ON pc.ctx = mm.ctx AND pc.byte = mm.byte LEFT JOIN (SELECT * FROM mm WHERE rk = 1) t ON pc.ctx = t.ctx)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not empty, as bytes."""
    return table(spark, sf_dir, "documents").where(F.octet_length("text") > 0).select("doc_id", "lang", F.col("text").cast("binary").alias("data"), F.octet_length("text").cast("long").alias("n_bytes"))


def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, ctx, byte, n): bytes after bytes within each document's part of a split."""
    sized = splits.split_sizes(documents(spark, sf_dir), SEQ, BATCH)
    return counts.pair_counts(splits.split_slices(sized), keys=("split",))


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the order-1 model of the training split says of each split. Counts are at most 65,536 rows a split: they come once, as rows
    of the driver's, so that the model's several uses scan nothing twice."""
    got = split_pairs(spark, sf_dir).toArrow()
    pairs = spark.createDataFrame(got)
    model = metrics.model_table(pairs.where("split = 'train'").select("ctx", "byte", "n"))
    return metrics.outcomes(pairs, model)


# --- bytes and counts


@query(f"WITH {BYTES} SELECT byte, count(*) AS n FROM b GROUP BY byte")
def byte_histogram(spark, sf_dir):
    return counts.byte_counts(documents(spark, sf_dir))


@query(f"WITH {BYTES} SELECT CAST(r AS INT) AS byte, count(b.byte) AS n FROM range(256) t(r) LEFT JOIN b ON b.byte = r GROUP BY r")
def byte_histogram_dense256(spark, sf_dir):
    return counts.dense(counts.byte_counts(documents(spark, sf_dir)))


@query(f"WITH {BYTES} SELECT count(DISTINCT byte) AS n_distinct, min(byte) AS lowest, max(byte) AS highest FROM b")
def distinct_bytes(spark, sf_dir):
    return counts.byte_counts(documents(spark, sf_dir)).agg(F.count("*").alias("n_distinct"), F.min("byte").alias("lowest"), F.max("byte").alias("highest"))


@query(f"WITH {BYTES} SELECT byte, CAST(row_number() OVER (ORDER BY byte) - 1 AS INT) AS idx FROM (SELECT DISTINCT byte FROM b)")
def vocab_table(spark, sf_dir):
    return counts.vocabulary(counts.byte_counts(documents(spark, sf_dir)))


@query("SELECT item_id, i AS pos, CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS INT) AS byte FROM (SELECT item_id, hex(encode(text)) AS h, unnest(range(strlen(text))) AS i FROM benchmark)")
def byte_explode(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", S.bytes_of(F.col("text").cast("binary")).alias("v"))
    return rows.select("item_id", F.posexplode("v").alias("pos", "byte")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {BYTES}, c AS (SELECT lang, byte, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS n_bytes FROM c) SELECT lang, CAST(any_value(n_bytes) AS BIGINT) AS n_bytes, round(sum(-n / n_bytes * log2(n / n_bytes)), 6) AS bits FROM t GROUP BY lang")
def entropy_order0_by_lang(spark, sf_dir):
    return metrics.entropy(counts.byte_counts(documents(spark, sf_dir), keys=("lang",)), ["lang"]).select("lang", "n_bytes", F.round("bits", 6).alias("bits"))


@query(f"WITH {BYTES}, p AS (SELECT lag(byte) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx, byte FROM b), c AS (SELECT ctx, byte, count(*) AS n FROM p WHERE ctx IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY ctx) AS tot FROM c) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(-n * log2(n / tot)) / sum(n), 6) AS bits FROM t")
def entropy_order1(spark, sf_dir):
    pairs = counts.pair_counts(documents(spark, sf_dir))
    p = pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("ctx")))
    return metrics.bits_per_byte(p, []).select("n", F.round("bpb", 6).alias("bits"))


@query(f"WITH {BYTES}, p AS (SELECT lag(byte) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx, byte FROM b) SELECT ctx, byte, count(*) AS n FROM p WHERE ctx IS NOT NULL GROUP BY ALL")
def next_byte_pairs(spark, sf_dir):
    return counts.pair_counts(documents(spark, sf_dir))


# --- chunks


@query(f"SELECT doc_id, n_bytes, {CHUNK}::BIGINT AS chunk_len, CAST(ceil(n_bytes / {CHUNK}.0::DOUBLE) AS INT) AS n_chunks, n_bytes - (CAST(ceil(n_bytes / {CHUNK}.0::DOUBLE) AS BIGINT) - 1) * {CHUNK} AS last_chunk_len FROM (SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) > 0)")
def chunk_plan(spark, sf_dir):
    return chunks.chunk_plan(documents(spark, sf_dir).select("doc_id", "n_bytes"), seq_size=CHUNK)


@query("WITH z AS (SELECT doc_id, strlen(text) AS n_bytes, CAST(ceil(strlen(text) / 7.0::DOUBLE) AS BIGINT) AS chunk_len FROM documents WHERE strlen(text) > 0) SELECT *, CAST(ceil(n_bytes / CAST(chunk_len AS DOUBLE)) AS INT) AS n_chunks, n_bytes - (CAST(ceil(n_bytes / CAST(chunk_len AS DOUBLE)) AS BIGINT) - 1) * chunk_len AS last_chunk_len FROM z")
def chunk_plan_by_count(spark, sf_dir):
    return chunks.chunk_plan(documents(spark, sf_dir).select("doc_id", "n_bytes"), chunks=7)


def _chunk_rows(spark, sf_dir, most=None):
    return chunks.chunk_ranges(chunks.chunk_plan(documents(spark, sf_dir), seq_size=CHUNK), most)


CHUNKS = f"c AS (SELECT doc_id, CAST(k AS INT) AS chunk_id, k * {CHUNK} AS \"offset\", least({CHUNK}, n_bytes - k * {CHUNK}) AS chunk_bytes, h FROM (SELECT doc_id, strlen(text) AS n_bytes, hex(encode(text)) AS h, unnest(range(CAST(ceil(strlen(text) / {CHUNK}.0::DOUBLE) AS BIGINT))) AS k FROM documents WHERE strlen(text) > 0))"


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_id, \"offset\", chunk_bytes FROM c")
def chunk_lengths(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select("doc_id", "chunk_id", "offset", "chunk_bytes")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_id, CAST('0x' || substr(h, CAST(2 * \"offset\" + 1 AS INT), 2) AS INT) AS first_byte FROM c")
def first_bytes(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select("doc_id", "chunk_id", chunks.first_byte(chunks.chunk_slice()).alias("first_byte"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_id, \"offset\", chunk_bytes FROM c WHERE chunk_id < 2")
def max_chunks_prefix(spark, sf_dir):
    return _chunk_rows(spark, sf_dir, most=2).select("doc_id", "chunk_id", "offset", "chunk_bytes")


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE strlen(text) > 0")
def chunks_joined(spark, sf_dir):
    """Chunks put together again in order."""
    rows = _chunk_rows(spark, sf_dir).select("doc_id", "chunk_id", chunks.chunk_slice().alias("data"))
    return chunks.joined(rows, "doc_id", "chunk_id", "data").select("doc_id", F.md5("data").alias("digest"))


# --- splits and batches


@query(f"WITH {SIZES} SELECT doc_id, n_bytes, usable, n_train, n_val, n_test FROM s")
def split_contiguous(spark, sf_dir):
    return splits.split_sizes(documents(spark, sf_dir).select("doc_id", "n_bytes"), SEQ, BATCH)


@query(f"SELECT doc_id, (strlen(text) // {SEQ * BATCH}) * {SEQ * BATCH} AS usable FROM documents WHERE strlen(text) > 0")
def align_blocks(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", splits.aligned(F.col("n_bytes"), SEQ, BATCH).alias("usable"))


@query(f"SELECT doc_id, CAST(s // {BATCH} AS INT) AS batch_id, CAST(s % {BATCH} AS INT) AS row_id, s * {SEQ} AS \"offset\" FROM (SELECT doc_id, unnest(range((strlen(text) // {SEQ * BATCH}) * {BATCH})) AS s FROM documents)")
def batch_ids(spark, sf_dir):
    return splits.batch_rows(documents(spark, sf_dir).select("doc_id", "n_bytes"), SEQ, BATCH).select("doc_id", "batch_id", "row_id", "offset")


@query(f"SELECT doc_id, count(*) AS n_rows FROM (SELECT doc_id, unnest(range(least((strlen(text) // {SEQ * BATCH}), 5) * {BATCH})) AS s FROM documents) GROUP BY doc_id")
def first_batches(spark, sf_dir):
    return splits.batch_rows(documents(spark, sf_dir).select("doc_id", "n_bytes"), SEQ, BATCH, most=5).groupBy("doc_id").agg(F.count("*").alias("n_rows"))


@query(f"WITH {BYTES} SELECT CASE WHEN pos < floor(n_bytes * 0.8::DOUBLE) THEN 'train' WHEN pos < floor(n_bytes * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM b GROUP BY 1")
def split_evaluation_cut(spark, sf_dir):
    a, b = F.floor(F.col("n_bytes") * 0.8), F.floor(F.col("n_bytes") * 0.9)
    sizes = F.array(F.struct(F.lit("train").alias("split"), a.alias("n")), F.struct(F.lit("val").alias("split"), (b - a).alias("n")), F.struct(F.lit("test").alias("split"), (F.col("n_bytes") - b).alias("n")))
    return documents(spark, sf_dir).select(F.explode(sizes).alias("s")).where("s.n > 0").groupBy("s.split").agg(F.sum("s.n").alias("n"))


# --- vocabulary


def _vocabulary(rows) -> dict[int, int]:
    return {r["byte"]: r["idx"] for r in counts.vocabulary(counts.byte_counts(rows)).collect()}  # at most 256 rows


@query(f"WITH {BYTES}, v AS (SELECT byte, row_number() OVER (ORDER BY byte) - 1 AS idx FROM (SELECT DISTINCT byte FROM b)) SELECT CAST(idx AS INT) AS byte, count(*) AS n FROM b JOIN v USING (byte) GROUP BY idx")
def remap_vocab(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "data")
    return counts.byte_counts(counts.remapped(docs, _vocabulary(docs)))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE strlen(text) > 0")
def inverse_remap_roundtrip(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "data")
    table_ = _vocabulary(docs)
    back = counts.remapped(counts.remapped(docs, table_), {v: k for k, v in table_.items()})
    return back.select("doc_id", F.md5("data").alias("digest"))


@query(f"WITH {SPLIT_BYTES} SELECT DISTINCT byte FROM sb WHERE split = 'test' AND byte NOT IN (SELECT byte FROM sb WHERE split = 'train')")
def unseen_bytes_anti(spark, sf_dir):
    """Bytes of the test split that the vocabulary of all training parts lacks; on text there may be none."""
    parts = splits.split_slices(splits.split_sizes(documents(spark, sf_dir), SEQ, BATCH))
    have = counts.byte_counts(parts.where("split = 'train'")).select("byte")
    return counts.byte_counts(parts.where("split = 'test'")).select("byte").join(have, "byte", "left_anti")


# --- prefixes and samples

BUDGET = 1_000_000


@query(f"SELECT doc_id, n_bytes, CAST(least(n_bytes, {BUDGET} - before) AS BIGINT) AS kept FROM (SELECT doc_id, strlen(text) AS n_bytes, sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS before FROM documents WHERE strlen(text) > 0) WHERE before < {BUDGET}")
def byte_budget_prefix(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "n_bytes")
    return records.byte_budget(docs, F.floor(F.col("doc_id") / 10000), ["doc_id"], "n_bytes", BUDGET)


@query(f"SELECT doc_id, n_bytes, CAST(least(n_bytes, {BUDGET} - before) AS BIGINT) AS kept FROM (SELECT doc_id, strlen(text) AS n_bytes, sum(strlen(text)) OVER (ORDER BY md5('7|' || doc_id), doc_id) - strlen(text) AS before FROM documents WHERE strlen(text) > 0) WHERE before < {BUDGET}")
def sample_seeded(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "n_bytes", F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))).alias("turn"))
    return records.byte_budget(docs, F.substring("turn", 1, 3), ["turn", "doc_id"], "n_bytes", BUDGET).drop("turn")


# --- the predictor's quality


@query(f"WITH {MODEL} SELECT split, CAST(sum(n) AS BIGINT) AS n, round(sum(-log2(p) * n) / sum(n), 6) AS bpb FROM o GROUP BY split")
def bits_per_byte_splits(spark, sf_dir):
    return metrics.bits_per_byte(outcome_rows(spark, sf_dir), ["split"]).withColumn("bpb", F.round("bpb", 6))


@query(f"WITH {MODEL} SELECT ctx, byte AS pred, round(p, 9) AS conf FROM mm WHERE rk = 1")
def predict_argmax(spark, sf_dir):
    pairs = split_pairs(spark, sf_dir).where("split = 'train'").drop("split")
    return metrics.model_table(pairs).where("rank = 1").select("ctx", F.col("byte").alias("pred"), F.round("p", 9).alias("conf"))


@query(f"WITH {MODEL} SELECT CAST(k AS INT) AS k, round(CAST(sum(CASE WHEN rk <= k THEN n ELSE 0 END) AS DOUBLE) / sum(n), 9) AS accuracy FROM o, range(1, 21) t(k) WHERE split = 'test' GROUP BY k")
def topk_accuracy(spark, sf_dir):
    return metrics.top_k(outcome_rows(spark, sf_dir).where("split = 'test'"), 20).withColumn("accuracy", F.round("accuracy", 9))


@query(f"WITH {MODEL} SELECT byte AS y, pred, CAST(sum(n) AS BIGINT) AS n FROM o WHERE split = 'test' GROUP BY ALL")
def confusion_counts(spark, sf_dir):
    return metrics.confusion(outcome_rows(spark, sf_dir).where("split = 'test'"))


@query(f"WITH {MODEL} SELECT byte AS y, pred, CAST(sum(n) AS BIGINT) AS n FROM o WHERE split = 'test' AND byte <> 32 GROUP BY ALL")
def confusion_without_spaces(spark, sf_dir):
    return metrics.confusion(outcome_rows(spark, sf_dir).where("split = 'test'"), ignore=32)


SQUARE = f"{MODEL}, cf AS (SELECT byte AS y, pred, CAST(sum(n) AS BIGINT) AS n FROM o WHERE split = 'test' GROUP BY ALL), tp AS (SELECT y FROM cf GROUP BY y ORDER BY sum(n) DESC, y LIMIT 20), sq AS (SELECT * FROM cf WHERE y IN (FROM tp) AND pred IN (FROM tp))"


def _normalised(by: str, over: str):
    def run(spark, sf_dir):
        counted = metrics.confusion(outcome_rows(spark, sf_dir).where("split = 'test'"))
        return metrics.normalised(counted, 20, by).withColumn("share", F.round("share", 9))

    run.__name__ = f"confusion_norm_{by}"
    query(f"WITH {SQUARE} SELECT y, pred, n, round({'CAST(n AS DOUBLE)' if by == 'none' else f'n / CAST(sum(n) OVER ({over}) AS DOUBLE)'}, 9) AS share FROM sq")(run)


for _by, _over in (("true", "PARTITION BY y"), ("pred", "PARTITION BY pred"), ("all", ""), ("none", "")):
    _normalised(_by, _over)


@query(f"WITH {SQUARE}, tr AS (SELECT y, sum(n) AS support, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS hits FROM cf GROUP BY y), pd AS (SELECT pred, sum(n) AS said FROM cf GROUP BY pred), j AS (SELECT y, support, hits / greatest(coalesce(said, 0), 1) AS p, hits / greatest(support, 1) AS r FROM tr LEFT JOIN pd ON tr.y = pd.pred) SELECT y AS byte, CAST(support AS BIGINT) AS support, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / greatest(p + r, 1e-12::DOUBLE), 9) AS f1 FROM j ORDER BY support DESC, y LIMIT 20")
def class_prf(spark, sf_dir):
    out = metrics.per_class(metrics.confusion(outcome_rows(spark, sf_dir).where("split = 'test'")), 20)
    return out.select("byte", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


CURVE = "cv AS (SELECT split, {bin} AS bin, CAST(sum(n) AS BIGINT) AS n, sum(conf * n) / sum(n) AS conf, sum(CASE WHEN pred = byte THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS acc FROM o GROUP BY ALL)"
UNIFORM = CURVE.format(bin="CAST(greatest(0, least(19, len(list_filter(list_transform(range(21), lambda i: i / 20.0::DOUBLE), lambda e: e < conf)) - 1)) AS INT)")


@query(f"WITH {MODEL}, {UNIFORM} SELECT split, bin, n, round(conf, 9) AS conf, round(acc, 9) AS acc FROM cv")
def calibration_uniform(spark, sf_dir):
    curve = metrics.calibration(outcome_rows(spark, sf_dir), [i / 20.0 for i in range(21)])
    return curve.select("split", "bin", "n", F.round("conf", 9).alias("conf"), F.round("acc", 9).alias("acc"))


@query(f"WITH {MODEL}, {UNIFORM} SELECT split, round(sum(abs(acc - conf) * n) / sum(n), 6) AS ece FROM cv GROUP BY split")
def ece_by_split(spark, sf_dir):
    curve = metrics.calibration(outcome_rows(spark, sf_dir), [i / 20.0 for i in range(21)])
    return metrics.expected_error(curve).withColumn("ece", F.round("ece", 6))


@query(f"WITH {MODEL}, x AS (SELECT conf, unnest(range(n)) AS i FROM o), ed AS (SELECT list_sort(list_distinct(quantile_cont(conf, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM x), " + "cv AS (SELECT split, CAST(greatest(0, least(len(e) - 2, len(list_filter(e, lambda q: q < conf)) - 1)) AS INT) AS bin, CAST(sum(n) AS BIGINT) AS n, sum(conf * n) / sum(n) AS conf, sum(CASE WHEN pred = byte THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS acc FROM o, ed GROUP BY ALL) SELECT split, bin, n, round(conf, 9) AS conf, round(acc, 9) AS acc FROM cv")
def calibration_quantile(spark, sf_dir):
    rows = outcome_rows(spark, sf_dir)
    curve = metrics.calibration(rows, metrics.quantile_edges(rows, 10))
    return curve.select("split", "bin", "n", F.round("conf", 9).alias("conf"), F.round("acc", 9).alias("acc"))


# --- index, distributions, coder


@query(f"WITH {CHUNKS}, x AS (SELECT doc_id, chunk_id, chunk_bytes, CAST(coalesce(sum(chunk_bytes) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c), d AS (SELECT *, \"offset\" - lag(\"offset\", 1, 0) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS delta FROM x) SELECT *, CAST(greatest(1, ceil(len(bin(delta)) / 7.0::DOUBLE)) AS INT) AS delta_bytes, CAST(greatest(1, ceil(len(bin(chunk_bytes)) / 7.0::DOUBLE)) AS INT) AS size_bytes FROM d")
def index_offsets(spark, sf_dir):
    rows = _chunk_rows(spark, sf_dir).select("doc_id", "chunk_id", "chunk_bytes")
    return index.offsets(rows, "doc_id", "chunk_bytes")


@query("SELECT doc_id, CAST(greatest(1, ceil(len(bin(doc_id * 7919)) / 7.0::DOUBLE)) AS INT) AS n FROM documents")
def uvarint_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.uvarint_length(F.col("doc_id") * 7919).alias("n"))


@query()
def chunk_crc32(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.crc32(F.col("html").cast("binary")).alias("crc"))


def _cdf(spark, sf_dir):
    dense = counts.dense(counts.byte_counts(documents(spark, sf_dir)))
    whole = dense.agg(F.array_sort(F.collect_list(F.struct("byte", (F.col("n") + 1).alias("c")))).alias("v"), (F.sum("n") + 256).alias("t"))  # one row of 256
    below = F.transform("v", lambda x: F.struct(x["byte"].alias("byte"), F.aggregate(F.filter("v", lambda y: y["byte"] < x["byte"]), F.lit(0).cast("long"), lambda a, y: a + y["c"]).alias("b"), x["c"].alias("c")))
    cells = whole.select("t", F.explode(below).alias("x"))
    bound = lambda c, i: F.expr(f"({TOTAL - 256} * ({c})) div t") + i
    return cells.select("x.byte", bound("x.b", F.col("x.byte")).alias("lo"), F.when(F.col("x.byte") == 255, F.lit(TOTAL)).otherwise(bound("x.b + x.c", F.col("x.byte") + 1)).cast("long").alias("hi"))


CDF = f"WITH {BYTES}, q AS (SELECT CAST(r AS INT) AS byte, count(b.byte) + 1 AS c FROM range(256) t(r) LEFT JOIN b ON b.byte = r GROUP BY r), w AS (SELECT byte, CAST(sum(c) OVER (ORDER BY byte) - c AS BIGINT) AS below, c, CAST(sum(c) OVER () AS BIGINT) AS tot FROM q), cdf AS (SELECT byte, ({TOTAL - 256} * below) // tot + byte AS lo, CASE WHEN byte = 255 THEN {TOTAL} ELSE ({TOTAL - 256} * (below + c)) // tot + byte + 1 END AS hi FROM w)"


@query(f"{CDF} SELECT byte, lo, hi FROM cdf")
def cdf_prefix(spark, sf_dir):
    return _cdf(spark, sf_dir)


@query(f"{CDF}, a AS (SELECT doc_id, (doc_id * 2654435761) % {TOTAL} AS q FROM documents) SELECT doc_id, q, byte FROM a JOIN cdf ON q >= lo AND q < hi")
def cdf_interval_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 2654435761) % TOTAL).alias("q"))
    return index.interval(_cdf(spark, sf_dir), asked).select("doc_id", "q", "byte")


def _compressed(spark, sf_dir, order=1):
    docs = documents(spark, sf_dir)
    model = train_counts(docs, order)
    rows = chunks.chunk_ranges(chunks.chunk_plan(docs, seq_size=4096)).select("doc_id", "chunk_id", chunks.chunk_slice().alias("data"))
    return codec.compress(codec.spread(rows), model), model


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE strlen(text) > 0")
def compress_roundtrip(spark, sf_dir):
    small, model = _compressed(spark, sf_dir)
    return chunks.joined(codec.decompress(small, model), "doc_id", "chunk_id", "data").select("doc_id", F.md5("data").alias("digest"))


@query()
def compress_sizes(spark, sf_dir):
    small, _ = _compressed(spark, sf_dir)
    return small.groupBy("doc_id").agg(F.sum("n").alias("original"), F.sum(F.length("stream") + 1).alias("compressed"))


@query()
def compression_ratio(spark, sf_dir):
    small, _ = _compressed(spark, sf_dir)
    total = small.agg(F.sum("n").alias("original"), F.sum(F.length("stream") + 1).alias("compressed"))
    return total.withColumn("ratio", S.ratio(F.col("original"), F.col("compressed")))


@query("SELECT vec_id, CAST(col AS INT) AS col, value FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS col, unnest(embedding) AS value FROM embeddings)")
def container_roundtrip(spark, sf_dir):
    """Vectors as raw bytes, one chunk each: compressed, written to a folder of containers, read and decoded."""
    rows = records.packed_records(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "embedding")
    width = rows.select(F.max(F.length("data"))).first()[0]
    model = train_counts(rows)
    path = f"{shared_dir(spark)}/container-{uuid.uuid4().hex}"
    container.save(codec.compress(container.ranged(rows, 8), model), path, width, model.fingerprint)
    back = codec.decompress(container.load(spark, path, fingerprint=model.fingerprint.hex()), model)
    flat = records.flat_records(back.select(F.col("chunk_id").cast("long").alias("vec_id"), "data"), [f"c{i}" for i in range(width // 4)], key="vec_id")
    return flat.select("vec_id", F.posexplode(F.array(*(F.col(f"c{i}") for i in range(width // 4)))).alias("col", "value"))


@query()
def container_metadata(spark, sf_dir):
    rows = records.packed_records(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "embedding")
    width = rows.select(F.max(F.length("data"))).first()[0]
    model, path = train_counts(rows, order=0), f"{shared_dir(spark)}/container-{uuid.uuid4().hex}"
    container.save(codec.compress(container.ranged(rows, 8), model), path, width, model.fingerprint)
    return container.metadata(spark, path)


@query()
def baseline_zlib_lzma(spark, sf_dir):
    return baselines.baseline_sizes(documents(spark, sf_dir)).drop("seconds")


@query("SELECT doc_id, 'ok' AS status FROM documents WHERE strlen(text) > 0")
def verify_bytes(spark, sf_dir):
    small, model = _compressed(spark, sf_dir, order=0)
    back = chunks.joined(codec.decompress(small, model), "doc_id", "chunk_id", "data")
    return compare.verify_bytes(documents(spark, sf_dir), back, "doc_id").select("doc_id", "status")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bytes differ' WHEN doc_id % 3 = 1 THEN 'sizes differ' ELSE 'ok' END AS status, CASE WHEN doc_id % 3 = 0 THEN 2 END AS first_diff FROM documents WHERE strlen(text) > 5")
def verify_damaged(spark, sf_dir):
    """A third of the documents with one byte changed, a third cut by one."""
    docs = documents(spark, sf_dir).where("n_bytes > 5").select("doc_id", "data", "n_bytes")
    third = F.col("doc_id") % 3
    cut = F.substring(F.col("data"), F.lit(1), (F.col("n_bytes") - 1).cast("int"))
    changed = F.concat(F.substring("data", 1, 2), F.lit(b"\x00"), F.substring(F.col("data"), F.lit(4), F.col("n_bytes").cast("int")))
    damaged = docs.select("doc_id", F.when(third == 0, changed).when(third == 1, cut).otherwise(F.col("data")).alias("data"))
    return compare.verify_bytes(docs, damaged, "doc_id").select("doc_id", "status", F.col("first_diff").cast("int").alias("first_diff"))


# --- records


def _cells(spark, sf_dir):
    return records.matrix_cells(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


CELLS = "cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS col, unnest(embedding) AS value FROM embeddings)"


@query(f"WITH {CELLS} SELECT vec_id, CAST(col AS INT) AS col, value FROM cells")
def matrix_view(spark, sf_dir):
    """Vectors as raw floats and back as columns of rows."""
    width = table(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).first()[0]
    raw = records.packed_records(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    flat = records.flat_records(raw, [f"c{i}" for i in range(width)], key="vec_id")
    return flat.select("vec_id", F.posexplode(F.array(*(F.col(f"c{i}") for i in range(width)))).alias("col", "value"))


@query("SELECT vec_id, r AS row, [embedding[i + 1] FOR i IN range(5 * r, 5 * r + 5)] AS fields FROM (SELECT vec_id, embedding, unnest(range(least(10, len(embedding) // 5))) AS r FROM embeddings)")
def matrix_rows(spark, sf_dir):
    """The first ten rows of five numbers of each vector, a last part of a row dropped."""
    raw = records.packed_records(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    flat = records.flat_records(raw, [f"c{i}" for i in range(5)], key="vec_id", exact=False, max_rows=10)
    return flat.select("vec_id", "row", F.array(*(f"c{i}" for i in range(5))).alias("fields"))


@query("SELECT doc_id, least(strlen(d.text), strlen(b.text)) AS n, md5(substr(hex(encode(d.text)), 1, CAST(2 * least(strlen(d.text), strlen(b.text)) AS INT))) AS a, md5(substr(hex(encode(b.text)), 1, CAST(2 * least(strlen(d.text), strlen(b.text)) AS INT))) AS b FROM documents d JOIN benchmark b ON d.doc_id = b.item_id")
def common_lengths(spark, sf_dir):
    """Documents and benchmark items of one number, both cut to the shorter one's length."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    a, b = records.common_length(a, b, "doc_id")
    both = a.join(b.withColumnRenamed("data", "other"), "doc_id")
    return both.select("doc_id", F.octet_length("data").cast("long").alias("n"), F.md5(F.hex("data")).alias("a"), F.md5(F.hex("other")).alias("b"))


RANGES = f"{CELLS}, rg AS (SELECT col, count(*) AS n, avg(CAST(value AS DOUBLE)) AS mean, stddev_pop(CAST(value AS DOUBLE)) AS std, min(value) AS lo, max(value) AS hi FROM cells WHERE NOT isnan(value) GROUP BY col)"


@query(f"WITH {RANGES} SELECT CAST(col AS INT) AS col, n, round(mean, 9) AS mean, round(std, 9) AS std, lo, hi FROM rg")
def normalise_columns(spark, sf_dir):
    out = records.column_ranges(_cells(spark, sf_dir))
    return out.select("col", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "lo", "hi")


@query(f"WITH {RANGES} SELECT CAST(col AS INT) AS col, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value::DOUBLE - lo::DOUBLE) / (hi::DOUBLE - lo::DOUBLE) * 20), 19) END AS INT) AS bin, count(*) AS n FROM cells JOIN rg USING (col) WHERE NOT isnan(value) GROUP BY ALL")
def column_histogram(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    return records.column_histogram(cells, records.column_ranges(cells), 20)


@query("SELECT CASE c WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS \"column\", n, CAST(CASE WHEN c = 0 THEN n ELSE n - bad END AS BIGINT) AS n_equal, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS max_residual, c = 0 OR bad = 0 AS equal FROM (SELECT count(*) AS n, sum(CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END) AS bad FROM embeddings), range(2) t(c)")
def bit_exact(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("double").alias("x"), (F.col("vec_id") * 2.0).alias("y"))
    b = a.withColumn("y", F.when(F.col("vec_id") % 10 == 0, F.col("y") + 0.5).otherwise(F.col("y")))
    return compare.compare_columns(a, b, ["vec_id"], ["x", "y"])


@query("SELECT vec_id, sqrt(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE + embedding[3]::DOUBLE * embedding[3]::DOUBLE) AS magnitude, embedding[2]::DOUBLE - embedding[1]::DOUBLE AS residual FROM embeddings")
def vector_magnitude(spark, sf_dir):
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", S.magnitude(*e).alias("magnitude"), (e[1] - e[0]).alias("residual"))


@query("SELECT vec_id, round(exp(embedding[1]::DOUBLE - m) / s, 9) AS p FROM (SELECT vec_id, embedding, list_max(embedding)::DOUBLE AS m, list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE))) AS s FROM embeddings)")
def softmax_first(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(S.softmax(v), F.lit(0)), 9).alias("p"))


@query("SELECT CAST(k AS INT) AS k, round(CASE WHEN k > 0 THEN pow(k, 4.0) * exp(-2 * pow(k / 5.0::DOUBLE, 2.0)) * pow(k, -5.0::DOUBLE / 3) ELSE 0 END, 9) AS e FROM range(40) t(k)")
def energy_spectrum(spark, sf_dir):
    k = F.col("id").cast("double")
    return spark.range(40).select(F.col("id").cast("int").alias("k"), F.round(S.spectrum(k, 5.0), 9).alias("e"))


def _events(spark, sf_dir):
    """Jagged rows: a user's values in order of event."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return e.select("user_id", F.size("v").cast("double").alias("n"), F.transform("v", lambda x: x["value"]).alias("vals"), F.filter(F.transform("v", lambda x: x["value"]), lambda x: x > 50).alias("high"))


JAGGED = "j AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, list(value ORDER BY event_id) AS vals, list_filter(list(value ORDER BY event_id), lambda v: v > 50) AS high FROM events WHERE value IS NOT NULL GROUP BY user_id)"


@query(f"WITH {JAGGED}, w AS (SELECT max(len(vals)) AS a, max(len(high)) AS b FROM j) SELECT user_id, CAST(1 + a + b AS INT) AS width, round(n + list_sum(vals) + coalesce(list_sum(high), 0), 6) AS total, CAST(len(high) AS INT) AS n_high FROM j, w")
def jagged_pad(spark, sf_dir):
    events = _events(spark, sf_dir)
    rows = records.padded(events, records.sidecar(events, ["n", "vals", "high"]), "user_id")
    return rows.select("user_id", F.size("row").alias("width"), F.round(F.aggregate("row", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.col("lengths")["high"].alias("n_high"))


@query(f"WITH {JAGGED} SELECT user_id, n, vals, high FROM j")
def jagged_unpad_roundtrip(spark, sf_dir):
    events = _events(spark, sf_dir)
    meta = records.sidecar(events, ["n", "vals", "high"])
    return records.unpadded(records.padded(events, meta, "user_id"), meta, "user_id")


@query(f"WITH {JAGGED}, c AS (SELECT count(*) AS n, sum(CASE WHEN user_id % 7 = 0 AND len(vals) > 0 THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN len(high) > 0 AND user_id % 11 = 0 THEN 1 ELSE 0 END) AS cut FROM j) SELECT 'vals' AS \"column\", CASE WHEN bad > 0 THEN 'values differ' ELSE 'ok' END AS status, n, CAST(bad AS BIGINT) AS n_bad FROM c UNION ALL SELECT 'high', CASE WHEN cut > 0 THEN 'lengths differ' ELSE 'ok' END, n, CAST(cut AS BIGINT) FROM c")
def jagged_compare(spark, sf_dir):
    a = _events(spark, sf_dir)
    b = a.select("user_id", F.when(F.col("user_id") % 7 == 0, F.transform("vals", lambda v: v + 1)).otherwise(F.transform("vals", lambda v: v * (1 + 1e-7))).alias("vals"), F.when((F.col("user_id") % 11 == 0) & (F.size("high") > 0), F.slice("high", F.lit(1), F.size("high") - 1)).otherwise(F.col("high")).alias("high"))
    return compare.compare_lists(a, b, "user_id", ["vals", "high"])


@query(f"WITH {JAGGED} SELECT count(*) AS n_events, CAST(max(len(vals)) AS INT) AS max_vals, CAST(1 + max(len(vals)) AS INT) AS high_at FROM j")
def sidecar_json(spark, sf_dir):
    meta = records.sidecar_json(records.sidecar(_events(spark, sf_dir), ["n", "vals", "high"]))
    got = spark.range(1).select(F.from_json(F.lit(meta), records.SIDECAR).alias("m"))
    return got.select("m.n_events", F.col("m.branches")[1]["max_len"].alias("max_vals"), F.col("m.branches")[2]["col_offset"].alias("high_at"))


@query("WITH c AS (SELECT count(*) AS n, sum(CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END) AS bad FROM orders), f AS (SELECT unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS \"column\") SELECT f.\"column\", n, CAST(CASE WHEN f.\"column\" = 'o_totalprice' THEN bad ELSE 0 END AS BIGINT) AS n_bad, CASE WHEN f.\"column\" = 'o_totalprice' AND bad > 0 THEN 'values differ' ELSE 'ok' END AS status FROM c, f")
def struct_compare(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")))
    return compare.compare_records(a, b, ["o_orderkey"])


def _sides(spark, sf_dir):
    """Two sides of which either lacks some rows of the other's."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("double").alias("x"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 7 <> 0").withColumn("x", F.when(F.col("vec_id") % 11 == 0, F.col("x") + 1).otherwise(F.col("x")))


SIDES = "s AS (SELECT vec_id % 5 <> 0 AS a, vec_id % 7 <> 0 AS b, vec_id % 11 = 0 AS odd FROM embeddings WHERE vec_id % 35 <> 0)"


@query(f"WITH {SIDES} SELECT 'x' AS \"column\", count(*) AS n, count(*) FILTER (a AND b AND NOT odd) AS n_equal, 1.0::DOUBLE AS max_residual, count(*) = count(*) FILTER (a AND b AND NOT odd) AS equal FROM s")
def compare_columns_rows(spark, sf_dir):
    return compare.compare_columns(*_sides(spark, sf_dir), ["vec_id"], ["x"])


@query(f"WITH {SIDES} SELECT 'v' AS \"column\", CASE WHEN count(*) FILTER (NOT (a AND b)) > 0 THEN 'rows differ' ELSE 'ok' END AS status, count(*) AS n, count(*) FILTER (NOT (a AND b)) AS n_bad FROM s")
def compare_lists_rows(spark, sf_dir):
    return compare.compare_lists(*_sides(spark, sf_dir), "vec_id", ["v"])


@query(f"WITH {SIDES}, r AS (SELECT 'v' AS \"column\", count(*) AS n, count(*) FILTER (NOT (a AND b)) AS n_bad FROM s UNION ALL SELECT 'x', count(*), count(*) FILTER (NOT (a AND b AND NOT odd)) FROM s) SELECT row_number() OVER (ORDER BY \"column\") AS line, \"column\", 'rows differ' AS status, n, n_bad FROM r UNION ALL SELECT 3, 'OVERALL', 'differs', max(n), CAST(sum(n_bad) AS BIGINT) FROM r")
def compare_report(spark, sf_dir):
    """The columns of two tables that lack rows of each other's, in order, with an overall line."""
    return compare.report(compare.compare_records(*_sides(spark, sf_dir), ["vec_id"])).withColumn("line", F.col("line").cast("long"))


@query("SELECT 'v' AS \"column\", 'values differ' AS status, count(*) AS n, count(*) FILTER (vec_id % 2 = 0 OR vec_id % 3 = 0) AS n_bad FROM embeddings")
def compare_infinities(spark, sf_dir):
    """A finite number against infinity is not close, in either order; infinity to itself and NaN to NaN are."""
    inf, nan = float("inf"), float("nan")
    rows, k = table(spark, sf_dir, "embeddings").select("vec_id"), F.col("vec_id")
    a = rows.select("vec_id", F.array(F.lit(1.0), F.lit(inf), F.lit(nan), F.when(k % 3 == 0, inf).otherwise(2.0)).alias("v"))
    b = rows.select("vec_id", F.array(F.when(k % 2 == 0, inf).otherwise(1.0), F.lit(inf), F.lit(nan), F.lit(2.0)).alias("v"))
    return compare.compare_lists(a, b, "vec_id", ["v"])


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / s1 * 0.5::DOUBLE, 6) AS l_quantity, round((l_tax - m2) / s2, 6) AS l_tax FROM lineitem, (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM lineitem)")
def scaled_columns(spark, sf_dir):
    """Columns shifted to mean 0 and scaled to deviations of 0.5 and 1."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return datasets.normalised(rows, {"l_quantity": 0.5, "l_tax": 1.0}).withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax")})


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 500")
def event_limit(spark, sf_dir):
    """The first 500 events, or all."""
    return records.first_events(table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"], 500)


@query("SELECT conv_id, turn, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations")
def cumulative_hits(spark, sf_dir):
    """Whether an answer stands at this turn of a conversation or before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").cast("int").alias("hit"))
    return recurrent.cumulative_hits(rows, ["conv_id"], "turn", "hit").select("conv_id", "turn", "seen")


@query("SELECT vec_id, pos, round(exp(v - m) / s, 9) AS p FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v, list_max(embedding)::DOUBLE AS m, list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))) AS s FROM embeddings)")
def softmax_rows(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.softmax(F.col("embedding").cast("array<double>"))).alias("pos", "p"))
    return p.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("p", 9).alias("p"))


# --- ordered operators and array forms


@query("SELECT event_id, round(0.1::DOUBLE * coalesce(lag(value, 3) OVER w, 0) + 0.2::DOUBLE * coalesce(lag(value, 2) OVER w, 0) + 0.3::DOUBLE * coalesce(lag(value, 1) OVER w, 0) + 0.4::DOUBLE * coalesce(value, 0) + 1, 6) AS conv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def causal_convolution(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return recurrent.causal_convolution(rows, "user_id", "event_id", "value", [0.1, 0.2, 0.3, 0.4], 1.0).select("event_id", F.round("conv", 6).alias("conv"))


@query("SELECT vec_id, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda v: v::DOUBLE)), lambda h, x: exp(-0.5::DOUBLE) * h + 0.25::DOUBLE * x), 9) AS state FROM embeddings")
def state_recurrence(spark, sf_dir):
    values = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(recurrent.recurrence(values, F.exp(F.lit(-0.5)), F.lit(0.25)), 9).alias("state"))


@query("WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, i, x, abs(x) AS dt, sum(abs(x)) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e) SELECT vec_id, round(sum(dt * x * exp(-coalesce(later, 0))), 8) AS state FROM c GROUP BY vec_id")
def selective_recurrence(spark, sf_dir):
    """The state after steps that the values themselves choose: dt = |x|."""
    values = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(recurrent.selective_recurrence(values, F.transform(values, F.abs)), 8).alias("state"))


@query(f"WITH {MODEL}, x AS (SELECT rk, CAST(sum(n) AS BIGINT) AS n FROM o WHERE split = 'test' GROUP BY rk) SELECT CAST(rk AS INT) AS rank, n, CAST(sum(n) OVER (ORDER BY rk) AS BIGINT) AS within FROM x")
def rank_histogram(spark, sf_dir):
    """Positions by the rank of their true byte, and how many are at that rank or better (at most 256 rows)."""
    per = outcome_rows(spark, sf_dir).where("split = 'test'").groupBy("rank").agg(F.sum("n").alias("n"))
    other = per.select(F.col("rank").alias("r"), F.col("n").alias("m"))
    return per.join(F.broadcast(other), F.col("r") <= F.col("rank")).groupBy("rank", "n").agg(F.sum("m").alias("within")).withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {BYTES} SELECT byte, n FROM (SELECT byte, count(*) AS n FROM b GROUP BY byte ORDER BY n DESC, byte LIMIT 20)")
def top_bytes(spark, sf_dir):
    """The twenty commonest bytes, then in order of value."""
    rows = counts.byte_counts(documents(spark, sf_dir)).withColumnRenamed("byte", "y")
    return metrics.top_classes(rows, 20).select(F.col("y").alias("byte"), F.col("support").alias("n")).orderBy("byte")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_id, md5(unhex(substr(h, CAST(2 * \"offset\" + 1 AS INT), CAST(2 * chunk_bytes AS INT)))) AS digest FROM c")
def payload_slices(spark, sf_dir):
    """The index joined to the payload by offset and length."""
    docs = documents(spark, sf_dir)
    entries = index.offsets(_chunk_rows(spark, sf_dir).select("doc_id", "chunk_id", "chunk_bytes"), "doc_id", "chunk_bytes")
    return entries.join(docs.select("doc_id", "data"), "doc_id").select("doc_id", "chunk_id", F.md5(index.payload_slice(F.col("data"), F.col("offset"), F.col("chunk_bytes"))).alias("digest"))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[2] AS first, embedding[1] AS second FROM embeddings")
def stack_and_flatten(spark, sf_dir):
    """Fields side by side along the last axis, flattened row by row."""
    half = F.flatten(F.transform("embedding", lambda v: F.array(v)))
    swapped = F.concat(F.slice(half, 2, 1), F.slice(half, 1, 1), F.slice(half, F.lit(3), F.size(half)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(swapped).alias("n"), F.get(swapped, F.lit(0)).alias("first"), F.get(swapped, F.lit(1)).alias("second"))


@query("SELECT CAST(max(c) AS INT) AS most, CAST(min(c) AS INT) AS least, CAST(sum(c) AS BIGINT) AS total FROM (SELECT count(*) AS c FROM conversations GROUP BY conv_id)")
def list_lengths(spark, sf_dir):
    """Lengths of jagged rows: turns of conversations."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("t")).select(F.size("t").alias("c"))
    return n.agg(F.max("c").alias("most"), F.min("c").alias("least"), F.sum("c").alias("total"))


@query("SELECT k AS n, round(CASE WHEN k > 0 THEN 8.0::DOUBLE / k ELSE CAST('inf' AS DOUBLE) END, 9) AS ratio, round(k / ln(2::DOUBLE), 9) AS bits FROM range(20) t(k)")
def ratio_and_bits(spark, sf_dir):
    k = F.col("id").cast("double")
    return spark.range(20).select(F.col("id").alias("n"), F.round(S.ratio_of_bits(k), 9).alias("ratio"), F.round(S.bits(k), 9).alias("bits"))


# --- names


@query("SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^0-9A-Za-z._-]', '_', 'g'), '_+', '_', 'g'), 1, 64) AS name FROM pages")
def sanitize_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.safe_name(F.col("url")).alias("name"))


@query("SELECT page_id, 'https://data.example.org/store/' || page_id || '.bin' AS url FROM pages")
def root_to_https(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.root_to_https(F.concat(F.lit("root://server.example.org//store/"), F.col("page_id").cast("string"), F.lit(".bin")), "data.example.org").alias("url"))


@query("SELECT p_brand, max(p_partkey % 997) AS epoch FROM part GROUP BY p_brand")
def latest_checkpoint(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("model_epoch"), (F.col("p_partkey") % 997).cast("string"), F.lit(".bin")).alias("path"))
    epoch = F.regexp_extract("path", r"epoch_?(\d+)", 1).cast("long")
    return named.groupBy("p_brand").agg(F.regexp_extract(F.max_by("path", epoch), r"epoch_?(\d+)", 1).cast("long").alias("epoch"))


@query("SELECT lang, arg_max(doc_id, (strlen(text), -doc_id)) AS doc_id FROM documents GROUP BY lang")
def largest_file(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.max_by("doc_id", F.struct(F.octet_length("text"), -F.col("doc_id"))).alias("doc_id"))


@query("SELECT CAST(user_id AS VARCHAR) AS src_id, CAST(sum(strlen(line)) AS BIGINT) AS n, CAST(ceil(sum(strlen(line)) / 1024.0::DOUBLE) AS BIGINT) AS chunks, md5(string_agg(line, '' ORDER BY event_id)) AS digest FROM (SELECT user_id, event_id, concat_ws(',', event_id, event_type, props) || chr(10) AS line FROM events) GROUP BY user_id")
def stream_chunks(spark, sf_dir):
    """Events as a stream of lines for each user: chunked in state, compressed, written, read back and decoded. Each user's last event ends
    their chunks, so that no byte waits for more."""
    from .streaming.chunks import compress_stream

    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.concat_ws(",", F.col("event_id").cast("string"), "event_type", "props"), F.lit("\n")).cast("binary").alias("data")
    model, base = train_counts(source.select(line)), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last = source.groupBy("user_id").agg(F.max("event_id").alias("last"))
    # A stream of files needs a folder; the table's file is matched by name in its own.
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    rows = stream.join(last, "user_id").select(F.col("user_id").cast("string").alias("src_id"), F.col("event_id").alias("seq"), line, (F.col("event_id") == F.col("last")).alias("end"))
    compress_stream(rows, model, f"{base}/out", f"{base}/state", 1024, end="end").awaitTermination()
    back = codec.decompress(spark.read.parquet(f"{base}/out"), model)
    sizes = back.groupBy("src_id").agg(F.sum(F.length("data")).alias("n"), F.count("*").alias("chunks"))
    return chunks.joined(back, "src_id", "chunk_id", "data").join(sizes, "src_id").select("src_id", "n", "chunks", F.md5("data").alias("digest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: the vectors are centred and rotated (iterative quantisation, fitted on at most FIT_ROWS vectors, those of least hashed id),
and each coordinate's sign is a bit. The Hamming radius is the least one that holds SHARE of the true neighbours within that same
sample; a larger table's neighbours are nearer, so the share found there is higher. Queries that find fewer than k look again at all.

Index: every distinct vector, once, in blocks of at most BLOCK_ROWS; a class of equal vectors keeps the smallest ids that a query can
ask for, k + 1, and the first of them holds its place. Each block indexes the substrings of its codes. If two codes differ in r bits,
they differ in few of one of the substrings' bits (pigeonhole), so that probing each substring's buckets around the query's finds
every code within the radius; those are compared in full and reranked by the inner product in double precision.

The queries, a stated share of the rows, meet the index in blocks; nothing is broadcast but codebook and radius, of fixed size. Each
meeting returns the k best, which a ranked window reduces before it shuffles.

Defined results: vectors that are null, zero, of another length than the most common one, or hold null or non-finite components, and rows
without an id, take no part; rows that repeat an id and a vector count once, and those that
repeat an id with other vectors are asked and answered under it together; if there are fewer candidates than k, all are returned;
other columns are ignored.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FIT_ROWS, ROUNDS, SHARE = 4096, 30, 0.97
BLOCK_ROWS, QUERY_ROWS, SUBSTRING = 8192, 512, 8
_PROBES = np.argsort(np.bitwise_count(np.arange(256, dtype=np.uint8)), kind="stable")
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(256, dtype=np.uint8)), minlength=9))


class Codebook:
    """A rotation learned by iterative quantisation, and the radius that its codes need."""

    def __init__(self, sample: np.ndarray, k: int):
        n, dim = sample.shape
        self.bits = -(-dim // SUBSTRING) * SUBSTRING
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        axes = np.linalg.svd(x.T @ x)[0]
        turn = np.linalg.qr(np.random.default_rng(7).normal(size=(dim, self.bits)).T)[0].T if self.bits > dim else np.linalg.qr(np.random.default_rng(7).normal(size=(dim, dim)))[0]
        low = x @ axes
        for _ in range(ROUNDS if self.bits == dim else 0):
            u, _, vt = np.linalg.svd(np.sign(low @ turn).T @ low)
            turn = (u @ vt).T
        self.turn = axes @ turn
        asked = sample[:: max(1, n // 256)]
        score = asked @ sample.T
        score[np.arange(len(asked)), np.arange(n)[:: max(1, n // 256)]] = -np.inf
        k = min(k, n - 1)
        self.radius = self.bits
        if k > 0:
            best = np.argpartition(-score, k - 1, axis=1)[:, :k]
            code = self.codes(sample)
            apart = hamming(self.codes(asked)[:, None], code[best])
            self.radius = int(np.ceil(np.quantile(apart, SHARE)))

    def wide(self) -> Codebook:
        """The same codes with a radius that holds every code."""
        out = copy.copy(self)
        out.radius = self.bits
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings) bytes."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class Block:
    """Codes of a block of vectors, with an index of each substring's values."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.start = np.stack([np.r_[0, np.cumsum(np.bincount(c, minlength=256))] for c in codes.T])

    def within(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """(queries, rows): which codes are within the radius of each query's, by probing the substrings' buckets."""
        m = self.codes.shape[1]
        hit = np.zeros((len(asked), len(self.codes)), bool)
        for j in range(m):
            reach = radius // m - (j > radius % m)  # r = m * a + b: one of b + 1 substrings differs by a at most, or another by a - 1
            if reach < 0:
                continue
            value = asked[:, j, None] ^ _PROBES[: _WITHIN[min(reach, 8)]].astype(np.uint8)[None]
            lo = self.start[j][value]
            count = self.start[j][value.astype(np.int64) + 1] - lo
            query = np.repeat(np.arange(len(asked)), count.sum(axis=1))
            lo, count = lo.ravel(), count.ravel()
            to = np.cumsum(count)
            hit[query, self.order[np.arange(to[-1]) + np.repeat(lo - (to - count), count), j]] = True
        query, row = np.nonzero(hit)
        hit[query, row] = hamming(asked[query], self.codes[row]) <= radius
        return hit


def search_block(ids, classes, vectors, query_ids, queries, book: Codebook, k: int):
    """(query id, vector id, score) of the k best that the block has for each query; ids: of each row, classes: its distinct vector."""
    block, out = Block(book.codes(vectors)), []
    bounds = np.searchsorted(classes, np.arange(len(vectors) + 1))
    for i in range(0, len(queries), 64):
        some = queries[i : i + 64]
        hit = block.within(book.codes(some), book.radius)
        for q, own in enumerate(query_ids[i : i + 64]):
            row = np.flatnonzero(hit[q])
            score = vectors[row] @ some[q]  # of what probing found, and nothing else
            if len(row) > k + 1:  # the k + 1 best vectors have k ids besides the query's own, and their ties
                keep = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                row, score = row[keep], score[keep]
            count = bounds[row + 1] - bounds[row]
            to = np.cumsum(count)
            id_ = ids[np.arange(to[-1] if len(to) else 0) + np.repeat(bounds[row] - (to - count), count)]
            score = np.repeat(score, count)
            score, id_ = score[id_ != own], id_[id_ != own]
            best = np.lexsort((id_, -score))[:k]
            out.append((np.full(len(best), own), id_[best], score[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


_RAW = "block long, ids binary, classes binary, vectors binary"


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


def _pack(dim: int):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("class_id", "ascending"), ("vec_id", "ascending")])
        classes = np.array(rows["class_id"].combine_chunks())
        new = np.r_[True, classes[1:] != classes[:-1]]
        vectors = _matrix(rows["vector"], dim)[new]
        return pa.table({"block": rows["block"][:1], "ids": [_bytes(np.array(rows["vec_id"].combine_chunks()), "<i8")], "classes": [_bytes(np.cumsum(new) - 1, "<i8")], "vectors": [_bytes(vectors, "<f8")]})

    return pack


def _search(book: Codebook, dim: int, k: int):
    def search(batches):
        for batch in batches:
            for ids, classes, vectors, asked, queries in zip(*(batch.column(n).to_pylist() for n in ("ids", "classes", "vectors", "q_ids", "q_vectors"))):
                ids, classes, asked = (np.frombuffer(x, "<i8") for x in (ids, classes, asked))
                q, v, s = search_block(ids, classes, np.frombuffer(vectors, "<f8").reshape(-1, dim), asked, np.frombuffer(queries, "<f8").reshape(-1, dim), book, k)
                yield pa.record_batch({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return search


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id ``every`` divides, the k rows of largest inner product."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vector", lambda v: v != 0))
    rows = rows.distinct()
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dim")).alias("most")).first()["most"]
    if sizes is None:
        return spark.createDataFrame([], schema)
    n, dim = sizes
    rows = materialise(rows.where(F.size("vector") == dim), "vectors")
    rows = rows.withColumn("class_key", F.md5(F.to_json("vector")))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vector").toArrow()
    book = Codebook(_matrix(sample["vector"], dim), k)

    ranked = Window.partitionBy("class_key").orderBy("vec_id")
    blocks = max(1, -(-n // BLOCK_ROWS))
    index = rows.withColumn("rn", F.row_number().over(ranked)).where(F.col("rn") <= k + 1)
    index = index.select(F.pmod(F.xxhash64("class_key"), F.lit(blocks)).alias("block"), F.col("class_key").alias("class_id"), "vec_id", "vector").groupBy("block").applyInArrow(_pack(dim), _RAW)
    index = materialise(index, "index")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)

    def search(asked: DataFrame, book: Codebook) -> DataFrame:
        asked = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // every // QUERY_ROWS)))).alias("block"), F.concat_ws("|", F.col("vec_id").cast("string"), "class_key").alias("class_id"), "vec_id", "vector")
        asked = asked.groupBy("block").applyInArrow(_pack(dim), _RAW).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("long"))).alias("block"))
        met = index.join(asked.repartition(F.col("block"), F.xxhash64("q_ids")), "block") if blocks == 1 else index.join(asked, "block")
        found = met.select("ids", "classes", "vectors", "q_ids", "q_vectors").mapInArrow(_search(book, dim, k), "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = materialise(search(asked, book), "near")
    # Queries with too few codes within the radius, far from everything, look at every code.
    full = near.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = materialise(asked.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return near
    return near.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(*near.columns).unionByName(search(short, book.wide()))

"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A document is a weighted set: a shingle that occurs n times weighs log2(1 + n). The weight axis of a shingle is cut into regions
[0, 1), [1, 2), [2, 4), ..., and hashed darts arrive in each as a Poisson process of the region's width: equal shingles of any two
documents get equal darts, at equal times and equal heights on the weight axis, and a document takes those below its own weight. It
throws until time (k ln k + 2k) / w, w its total weight, which makes about k ln k + 2k darts whatever its length; each dart falls on one of
k coordinates, and the earliest of each coordinate is its signature there; if a coordinate is still empty, the time doubles. Two
documents agree on a coordinate with the probability of their weighted Jaccard similarity.

Signatures join by bands. Documents of equal weighted sets form a class at once and one stands for them. In each band's bucket every
document is paired only with the most central one, which shares most buckets with others, so a bucket of any size makes a linear
number of pairs; pairs are checked exactly. A second round compares, in buckets whose documents are still in several groups, those
of different groups: in small buckets as pairs, in large ones in blocks of bounded rows and bytes, from which links leave that join
groups, a forest and never all pairs. Everywhere a pair is checked only if its signatures agree on ``agree`` coordinates. The default
lies so far under the 80 THRESHOLD that a pair of THRESHOLD is passed over with a probability of 1e-7, a hundredth of what the bands pass
over; 0 checks every pair. Linked groups are connected components.

Defined results: null, empty and wordless texts are linked to nothing; texts under five words are one shingle; a null doc_id takes
no part and has a null class; rows that share a doc_id are one document; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import components, drop, materialise

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * np.log(COORDINATES) + 2 * COORDINATES
#: Coordinates on which documents of THRESHOLD agree, 6.4 standard deviations down.
AGREE = int(COORDINATES * THRESHOLD - 6.4 * (COORDINATES * THRESHOLD * (1 - THRESHOLD)) ** 0.5)
#: Members of a block and their shingles; buckets compared as pairs.
BLOCK_ROWS, BLOCK_SHINGLES, PAIRED = 512, 1 << 19, 32
#: Similarities are sums of logarithms: this much less than THRESHOLD is equal to it.
SLACK = 1e-9
_MAX_DOCS = 4000
_COUNT = 24
U = np.uint64


def shingle_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct shingles as 52-bit hashes, how often each occurs, and the documents' offsets among them."""
    words, at = K.words_of(data, off)
    shingles, to = K.shingles_of(words, at, SHINGLE)
    counts, n_words = np.diff(to), np.diff(at)
    short = (n_words > 0) & (counts == 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    if short.any():  # one shingle for all of a text's words
        which = np.flatnonzero(short)
        whole = [K.mix64(np.add.reduce(words[at[d] : at[d + 1]] * K.powers(SHINGLE)[0][: n_words[d]], keepdims=True))[0] for d in which]
        shingles, doc = np.concatenate([shingles, np.array(whole, np.uint64)]), np.concatenate([doc, which])
    key = np.sort((doc.astype(np.uint64) << U(52)) | (shingles >> U(12)))
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.r_[head, len(key)])
    per = np.bincount((key[head] >> U(52)).astype(np.int64), minlength=len(counts))
    return key[head] & U(2**52 - 1), times, np.r_[0, np.cumsum(per)]


def weight(times: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + times)


def _salt(i: int) -> np.uint64:
    return U(i * 0xD6E8FEB86659FD93 % 2**64)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _regions(shingle: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle's place, hash, lower end, width) of the regions of the weight axis that each shingle's weight reaches into."""
    n = 1 + np.ceil(np.log2(np.maximum(w, 1.0))).astype(np.int64)
    place, level = np.repeat(np.arange(len(w)), n), K.ragged(np.zeros(len(w), np.int64), n)
    width = np.ldexp(1.0, np.maximum(level - 1, 0))
    return place, K.mix64(shingle[place] + level.astype(np.uint64) * U(0xA0761D6478BD642F)), np.where(level > 0, width, 0.0), width


def signatures(shingles: np.ndarray, w: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(documents, COORDINATES): the arrival time of the earliest dart of each coordinate, as a 45-bit value; 0 for no shingles."""
    n = np.diff(to)
    out = np.zeros((len(n), COORDINATES), np.uint64)
    place, region, low, width = _regions(shingles, w)
    doc = np.repeat(np.arange(len(n)), n)
    total = np.bincount(doc, w, len(n))
    owner, height = doc[place], w[place]
    pending, factor = np.flatnonzero(n > 0), 1.0
    row_of = np.full(len(n), -1)
    while len(pending):
        row_of[:] = -1
        row_of[pending] = np.arange(len(pending))
        limit = factor * DARTS / total[pending]
        open_ = np.flatnonzero(row_of[owner] >= 0)
        row, cell, rate, lo, top = row_of[owner[open_]], region[open_], width[open_], low[open_], height[open_]
        when, darts, throw = -np.log(_uniform(K.mix64(cell))) / rate, [], 1
        while True:
            hit = when <= limit[row]
            cell, row, when, rate, lo, top = (v[hit] for v in (cell, row, when, rate, lo, top))
            if not len(cell):
                break
            below = lo + rate * _uniform(K.mix64(cell + _salt(3 * throw))) < top
            coordinate = K.mix64(cell[below] + _salt(3 * throw + 1)) % U(COORDINATES)
            darts.append(((row[below].astype(np.uint64) * U(COORDINATES) + coordinate) << U(45)) | (when[below].view(np.uint64) >> U(19)))
            when = when - np.log(_uniform(K.mix64(cell + _salt(3 * throw + 2)))) / rate
            throw += 1
        darts = np.sort(np.concatenate(darts)) if darts else np.zeros(0, np.uint64)
        slot = darts >> U(45)
        first = np.r_[True, slot[1:] != slot[:-1]][: len(slot)]
        got = np.zeros(len(pending) * COORDINATES, np.uint64)
        got[slot[first].astype(np.int64)] = darts[first] & U(2**45 - 1)
        got = got.reshape(-1, COORDINATES)
        full = (got > 0).all(axis=1)
        out[pending[full]] = got[full]
        pending, factor = pending[~full], factor * 2
    return out


def _runs(off: np.ndarray):
    for a, b in K.slices(off):
        for i in range(a, b, _MAX_DOCS):
            yield i, min(i + _MAX_DOCS, b)


def _sums(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[U(0), np.cumsum(x, dtype=np.uint64)][to])


def _names(shingles: np.ndarray, times: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's weighted set."""
    h = K.mix64(shingles + times.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return _sums(h, to).view(np.int64), _sums(K.mix64(h), to).view(np.int64)


def _sign(batches):
    for batch in batches:
        data, off = K.text_buffer(batch.column("text"))
        for a, b in _runs(off):
            shingles, times, to = shingle_counts(data[off[a] : off[b]], off[a : b + 1] - off[a])
            sig = signatures(shingles, weight(times), to)
            k1, k2 = _names(shingles, times, to)
            bands = np.zeros((b - a, BANDS), np.uint64)
            for j in range(ROWS):
                bands = K.mix64(bands + sig[:, j::ROWS] + U(j))
            bands = K.mix64(bands + np.arange(BANDS, dtype=np.uint64)[None] * U(0x9E3779B97F4A7C15)).view(np.int64)
            some = np.diff(to) > 0
            ends = np.r_[0, np.cumsum(some * BANDS)].astype(np.int32)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").slice(a, b - a), "k1": k1, "k2": k2, "n": np.diff(to).astype(np.int32),
                "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[some].ravel())), "sig": pa.array([r.tobytes() for r in K.mix64(sig).astype(np.uint8)], pa.binary()),
            })


def _shingles(batches):
    for batch in batches:
        data, off = K.text_buffer(batch.column("text"))
        for a, b in _runs(off):
            found, times, to = shingle_counts(data[off[a] : off[b]], off[a : b + 1] - off[a])
            k1, k2 = _names(found, times, to)
            whole = (found >> U(52 - 64 + _COUNT) << U(_COUNT)) | np.minimum(times, 2**_COUNT - 1).astype(np.uint64)
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "k1": k1, "k2": k2, "cells": pa.array([whole[i:j].tobytes() for i, j in zip(to[:-1], to[1:])], pa.binary())})


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two documents' sorted (shingle, times) values."""
    wx, wy = (weight(v & U(2**_COUNT - 1)).sum() for v in (x, y))
    both = np.concatenate([x, y])
    both = both[np.argsort(both >> U(_COUNT), kind="stable")]
    same = np.flatnonzero(both[1:] >> U(_COUNT) == both[:-1] >> U(_COUNT))
    common = weight(np.minimum(both[same] & U(2**_COUNT - 1), both[same + 1] & U(2**_COUNT - 1))).sum()
    return float(common / max(wx + wy - common, 1e-12))


def _agreeing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, COORDINATES) for v in (x, y))
    return (a == b).sum(axis=1)


def _compare(agree: int):
    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(_agreeing(batch.column("xs").to_pylist(), batch.column("ys").to_pylist()) >= agree))
            out = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(out, pa.float64())})

    return compare


def _checked(cells: DataFrame, pairs: DataFrame, agree: int) -> DataFrame:
    """The pairs (a, b) of at least THRESHOLD, with their exact weighted Jaccard similarity."""
    got = pairs.join(cells.select(F.col("doc_id").alias("b"), F.col("cells").alias("y"), F.col("sig").alias("ys")), "b").join(cells.select(F.col("doc_id").alias("a"), F.col("cells").alias("x"), F.col("sig").alias("xs")), "a")
    return got.select("a", "b", "x", "y", "xs", "ys").mapInArrow(_compare(agree), "a long, b long, similarity double").where(F.col("similarity") >= THRESHOLD - SLACK)


def _block_links(agree: int):
    def links(rows: pa.Table) -> pa.Table:
        """Links that join groups among the documents of one block of a bucket, or of two blocks of it."""
        rows = rows.sort_by("doc_id")
        ids, groups, block = (np.array(rows[n].combine_chunks()) for n in ("doc_id", "class_id", "at"))
        same = rows["p"][0].as_py() == rows["q"][0].as_py()
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, COORDINATES)
        cells = [np.frombuffer(c, np.uint64) for c in rows["cells"].to_pylist()]
        sizes = np.array([len(c) for c in cells])
        total = np.array([weight(c & U(2**_COUNT - 1)).sum() for c in cells])
        # A bit for each shingle that several documents hold: shared bits, and all that further occurrences weigh, bound what a pair shares.
        _, value, n = np.unique(np.concatenate(cells) >> U(_COUNT), return_inverse=True, return_counts=True)
        common = np.cumsum(n > 1) - 1
        hit, row = n[value] > 1, np.repeat(np.arange(len(cells)), sizes)
        bits = np.zeros((len(cells), -(-int((n > 1).sum()) // 8) + 1), np.uint8)
        at = common[value[hit]]
        np.bitwise_or.at(bits, (row[hit], at // 8), np.uint8(1) << (at % 8).astype(np.uint8))
        out = []
        for i in range(0, len(ids), 64):
            some = slice(i, i + 64)
            ok = (groups[some, None] != groups[None]) & (ids[some, None] < ids[None])
            if not same:
                ok &= block[some, None] != block[None]
            x, y = np.nonzero(ok)
            keep = (sig[x + i] == sig[y]).sum(axis=1) >= agree
            x, y = x[keep] + i, y[keep]
            for j in range(0, len(x), 1 << 12):
                u, v = x[j : j + (1 << 12)], y[j : j + (1 << 12)]
                shared = np.bitwise_count(bits[u] & bits[v]).sum(axis=1, dtype=np.int64) + np.minimum(total[u] - sizes[u], total[v] - sizes[v])
                may = shared >= (THRESHOLD - SLACK) * (total[u] + total[v] - shared)
                for a, b in zip(u[may].tolist(), v[may].tolist()):
                    if groups[a] != groups[b] and (s := similarity(cells[a], cells[b])) >= THRESHOLD - SLACK:
                        out.append((int(ids[a]), int(ids[b]), s))
                        groups[groups == groups[b]] = groups[a]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())))})

    return links


def near_links(docs: DataFrame, agree: int = AGREE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed documents, copies (a, b), checked links (a, b, similarity) between texts of different shingles)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    signed = materialise(docs.mapInArrow(_sign, "doc_id long, k1 long, k2 long, n int, bands array<long>, sig binary"), "signed")
    some = signed.where("n > 0")
    # Aggregations are written before they are joined by their own key, so that adaptive execution can split a hot key's join.
    stands = materialise(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "stands")
    copies = materialise(some.select("doc_id", "k1", "k2").join(stands, ["k1", "k2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "copies")
    reps = some.join(stands.withColumnRenamed("rep", "doc_id"), ["k1", "k2", "doc_id"], "left_semi")
    buckets = reps.select("doc_id", "n", F.explode("bands").alias("band")).groupBy("doc_id", "band").agg(F.max("n").alias("n"))
    sizes = materialise(buckets.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    # The document that shares most buckets with others is likeliest to be what its neighbours were made from.
    central = buckets.join(sizes, "band").groupBy("doc_id").agg(F.sum("c").alias("central"))
    held = buckets.join(sizes.select("band"), "band", "left_semi").join(central, "doc_id")
    held = materialise(held, "held")
    hubs = materialise(held.groupBy("band").agg(F.max_by("doc_id", F.struct("central", -F.col("doc_id"))).alias("hub")), "hubs")
    buckets = held.select("band", "doc_id", "n")
    members = materialise(buckets.join(hubs, "band"), "members")
    cells = docs.join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(_shingles, "doc_id long, k1 long, k2 long, cells binary")
    # Rows that repeat are one. The texts of one doc_id each keep their own shingles and signature.
    signs = reps.groupBy("doc_id", "k1", "k2").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    cells = materialise(cells.groupBy("doc_id", "k1", "k2").agg(F.first("cells").alias("cells")).join(signs, ["doc_id", "k1", "k2"]), "cells")
    pairs = members.where("doc_id <> hub").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    links = materialise(_checked(cells, pairs, agree), "links")

    groups = components(links)
    placed = members.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    spread = placed.groupBy("band").agg(F.count("*").alias("c"), F.sum(F.col("n").cast("long")).alias("s"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo <> hi").select("band", "c", "s")
    mixed = materialise(placed.join(spread, "band"), "mixed")
    few = mixed.where(F.col("c") <= PAIRED)
    x, y = few.select("band", "hub", F.col("doc_id").alias("a"), F.col("class_id").alias("ac")), few.select("band", F.col("doc_id").alias("b"), F.col("class_id").alias("bc"))
    rest = x.join(y, "band").where("ac <> bc AND a < b AND a <> hub AND b <> hub").select("a", "b").distinct()
    more = _checked(cells, rest, agree)
    many = mixed.where(F.col("c") > PAIRED).withColumn("blocks", F.ceil(F.greatest(F.col("c") / BLOCK_ROWS, F.col("s") / BLOCK_SHINGLES)).cast("int")).withColumn("at", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", F.least("at", "other").alias("p"), F.greatest("at", "other").alias("q"), "at", "doc_id", "class_id")
    # Of a doc_id's texts those that the bucket holds, each with its own shingles.
    full = many.join(cells, "doc_id").where("array_contains(bands, band)").drop("bands")
    blocks = full.groupBy("band", "p", "q").applyInArrow(_block_links(agree), "a long, b long, similarity double")
    first, links = links, materialise(links.unionByName(more).unionByName(blocks), "links")
    drop(first, members, mixed, cells, held, hubs, sizes)
    return signed, copies, links


def near_dedup(docs: DataFrame, agree: int = AGREE) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group; its own if alone) and n_links (checked links to other texts that hold the group
    together) of each row."""
    signed, copies, links = near_links(docs, agree)
    groups = components(copies.unionByName(links.select("a", "b")))
    counts = links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    known = groups.withColumnRenamed("node", "doc_id").join(counts, "doc_id", "left")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

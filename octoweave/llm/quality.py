"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts in numpy, many texts at once. Trees are grown level by level on histograms of quantile bins
with Newton leaf values; a forest is three flat arrays (feature, threshold, leaf value) in heap order, which scoring walks for all
rows and trees at once. It is fitted on at most FIT_ROWS labelled rows that are not held out.

Defined results: null text is empty; empty texts and empty tables get scores like any other; without a labelled row of each class
every score is the share of label 1, or 0.5 without any; a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import held_out, labelled_sample

FIT_ROWS, FIT_BYTES = 8192, 1 << 20
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 3, 64, 0.2, 5.0, 1.0
THRESHOLD = 0.7
U = np.uint64

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*+<=>@[\\]^_`{|}~/",
    "exclaim": b"!?",
    "stop": b".,;:",
    "space": b" \t",
    "line": b"\n",
}
_IN = {name: np.isin(np.arange(256), np.frombuffer(members, np.uint8)) for name, members in _CLASSES.items()}
_HIGH = np.arange(256) > 127


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, statistics) of each text."""
    docs, size = len(off) - 1, np.diff(off)
    per = np.maximum(size, 1)

    def count(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags)][at])

    starts, ends, at = K.word_spans(data, off)
    words, lengths = K.span_hashes(data, starts, ends), ends - starts
    n_words = np.diff(at)
    of = np.maximum(n_words, 1)
    doc = np.repeat(np.arange(docs), n_words)
    again = np.r_[False, (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])] if len(words) else np.zeros(0, bool)
    key = np.sort((doc.astype(np.uint64) << U(44)) | (words >> U(20)))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    runs, run_doc = np.diff(np.r_[head, len(key)]), (key[head] >> U(44)).astype(np.int64)
    most = np.zeros(docs)
    np.maximum.at(most, run_doc, runs)
    histogram = np.bincount(np.repeat(np.arange(docs), size) * 256 + data, minlength=docs * 256).reshape(docs, 256) / per[:, None]
    entropy = -(histogram * np.log2(np.where(histogram > 0, histogram, 1))).sum(axis=1)
    mean = np.diff(np.r_[0, np.cumsum(lengths)][at]) / of
    square = np.diff(np.r_[0, np.cumsum(lengths**2)][at]) / of
    capital = count(_IN["upper"][data[starts]], at) if len(starts) else np.zeros(docs)
    long_ = count(lengths > 20, at)
    lines = histogram[:, 10] * per
    shares = [histogram[:, _IN[name]].sum(axis=1) for name in _CLASSES]
    return np.stack([
        np.log1p(size), np.log1p(n_words), *shares, histogram[:, _HIGH].sum(axis=1), entropy, histogram.max(axis=1), mean, np.sqrt(np.maximum(square - mean**2, 0)),
        np.bincount(run_doc, minlength=docs) / of, most / of, count(again, at) / of, capital / of, long_ / of, n_words / (lines + 1), np.log1p(lines),
    ], axis=1)


class Forest:
    """Boosted trees of fixed depth in flat arrays: node i of a tree has children 2i + 1 and 2i + 2."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = float(y.mean()) if len(y) else 0.5
        self.bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (0.0 if not len(y) else np.sign(share - 0.5) * 5.0)
        inner = 2**DEPTH - 1
        self.feature, self.threshold, self.value = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
        if not len(y) or not 0 < share < 1:
            return
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        bins = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], axis=1)
        n, features = x.shape
        flat = bins + np.arange(features) * BINS
        margin = np.full(n, self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, f, t = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                cell = ((node - first)[:, None] * features * BINS + flat).ravel()
                sums = [np.bincount(cell, np.repeat(v, features), width * features * BINS).reshape(width, features, BINS) for v in (g, h)]
                gl, hl = (np.cumsum(s, axis=2)[:, :, :-1] for s in sums)
                gt, ht = (s.sum(axis=2)[:, :, None] for s in sums)
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                rows = np.cumsum(np.bincount(cell, minlength=width * features * BINS).reshape(width, features, BINS), axis=2)
                gain[(rows[:, :, :-1] < LEAST) | (rows[:, :, -1:] - rows[:, :, :-1] < LEAST)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                for k, b in enumerate(best):
                    column, cut = divmod(int(b), BINS - 1)
                    if gain[k, column, cut] > 1e-9 and cut < len(edges[column]):
                        f[first + k], t[first + k] = column, edges[column][cut]
                node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
            leaf = node - inner
            value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
            margin += value[leaf]
            self.feature, self.threshold, self.value = (np.concatenate([a, b[None]]) for a, b in ((self.feature, f), (self.threshold, t), (self.value, value)))

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = len(self.feature)
        node, tree = np.zeros((len(x), trees), np.int64), np.arange(trees)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (np.take_along_axis(x, self.feature[tree, node], axis=1) > self.threshold[tree, node])
        margin = self.bias + self.value[tree, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


_DOCS = 4000


def _rows(batch: pa.RecordBatch):
    data, off = K.text_buffer(batch.column("text"))
    for a, b in K.slices(off):
        for i in range(a, b, _DOCS):
            j = min(i + _DOCS, b)
            yield i, j, statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _statistics(batches):
    for batch in batches:
        for i, j, x in _rows(batch):
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "label_": batch.column("label_").slice(i, j - i), "x": rows})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> tuple[Forest, bool]:
    """The forest, and whether there was a labelled row of each class to fit it on."""
    got = labelled_sample(docs, labels, label, rows, FIT_BYTES).mapInArrow(_statistics, "doc_id long, label_ int, x array<double>").toPandas()
    got = got.sort_values(["doc_id"], kind="stable")
    y = got["label_"].to_numpy(float)
    x = np.stack(got["x"].tolist()) if len(got) else np.zeros((0, 1))
    return Forest(x, y), bool(len(y)) and 0 < y.mean() < 1


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""

    def score(batches):
        for batch in batches:
            for i, j, x in _rows(batch):
                s = forest.score(x)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "held_out": batch.column("held_out").slice(i, j - i), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` that the forest does not reject, all columns as they are; one pass, no join."""
    columns = docs.columns

    def keep(batches):
        for batch in batches:
            ok = np.concatenate([forest.score(x) >= THRESHOLD for _, _, x in _rows(batch)]) if batch.num_rows else np.zeros(0, bool)
            yield batch.filter(pa.array(ok)).select(columns)

    return docs.mapInArrow(keep, docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels)[0])

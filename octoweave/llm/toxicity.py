"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Every text is scored over all its overlapping windows of WINDOW words, STRIDE apart. A word enters as three parts: its smoothed
log-odds of label 1 among the training texts, a learned vector of its own if it occurred in three training texts, and the mean of learned
vectors of its byte trigrams. A gated recurrent unit reads the window in each direction; attention weighs the joined states into one
vector, and a linear layer gives the window's logit. A text's logit is its largest window's, so training is multiple-instance: each
round scores all windows, and the step is taken on each text's strongest window (and a random one of label-0 texts). Gates use
x / (1 + |x|) in place of tanh and its shifted half for the logistic function, which is the same on every machine and cheap.

A quarter of the training texts is kept from fitting and calibrates the logit (with the number of windows) to a probability. Training
takes at most FIT_ROWS labelled rows that are not held out, of at most FIT_BYTES each; scoring takes everything. Input projections are
made once a word, and all windows of a slice step together.

Defined results: null text is empty; texts without words get the calibrated score of the bias; without training rows of both classes
every score is the share of label 1, or 0.5 without any; a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import held_out, labelled_sample

FIT_ROWS, FIT_BYTES = 3000, 1 << 14
WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS = 32, 16, 8, 4, 4, 4096
INPUT = 1 + WORD_DIM + CHAR_DIM
STEPS, ROUNDS, BATCH, RATE, DECAY, LEAST_TEXTS = 400, 6, 128, 0.01, 1e-5, 3
THRESHOLD = 0.3
_LANES, _WORDS = 2048, 1 << 15
U = np.uint64
F32 = np.float32


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def slope(x: np.ndarray) -> np.ndarray:
    return 1 / np.square(1 + np.abs(x))


class Words:
    """Words of many texts: hashes, byte trigrams, and the windows over them."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        starts, ends, self.at = K.word_spans(data, off)
        self.hash = np.zeros(len(starts), np.uint64)
        self.trigram = np.zeros(len(data), np.int16)
        for i, j in K.slices(off):
            a, b = self.at[i], self.at[j]
            self.hash[a:b] = K.span_hashes(data[off[i] : off[j]], starts[a:b] - off[i], ends[a:b] - off[i])
            c = np.r_[K.FOLD[data[off[i] : off[j]]], np.zeros(2, np.uint8)].astype(np.uint32)
            self.trigram[off[i] : off[j]] = (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) * np.uint32(2654435761) >> np.uint32(20)
        self.starts, self.lengths = starts, np.maximum(ends - starts - 2, 1)
        n = np.diff(self.at)
        self.count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        self.to = np.r_[0, np.cumsum(self.count)]
        first = K.ragged(np.zeros(len(n), np.int64), self.count) * STRIDE + np.repeat(self.at[:-1], self.count)
        self.left = np.minimum(np.repeat(self.at[1:], self.count) - first, WINDOW)
        self.first = first

    def places(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, mask), both (windows, WINDOW); a place past the text's end is masked and names word 0."""
        step = np.arange(WINDOW)
        mask = step < self.left[windows][:, None]
        return np.where(mask, self.first[windows][:, None] + step, 0), mask


class Network:
    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, share: float):
        rng = np.random.default_rng(5)
        self.vocabulary, self.odds = vocabulary, odds.astype(F32)
        g = 3 * HIDDEN
        self.p = {
            "word": rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)), "char": rng.normal(0, 0.1, (CHAR_ROWS, CHAR_DIM)),
            "wx": rng.normal(0, 0.4, (2, INPUT, g)), "wh": rng.normal(0, 0.3, (2, HIDDEN, g)), "b": np.zeros((2, g)),
            "wa": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "va": rng.normal(0, 0.3, HIDDEN), "wo": rng.normal(0, 0.3, 2 * HIDDEN), "bo": np.zeros(1),
        }
        self.p = {k: v.astype(F32) for k, v in self.p.items()}
        self.calibration = np.array([1.0, 0.0, 0.0])
        self.share, self.fitted = share, False

    def inputs(self, words: Words, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(word rows, inputs) of the words from first to last - 1, some at a time."""
        last = len(words.hash) if last is None else last
        row, x = np.zeros(last - first, np.int32), np.zeros((last - first, INPUT), F32)
        for a in range(first, last, _WORDS):
            b = min(a + _WORDS, last)
            at = np.minimum(np.searchsorted(self.vocabulary, words.hash[a:b]), len(self.vocabulary) - 1)
            some = np.where(self.vocabulary[at] == words.hash[a:b], at, len(self.vocabulary))
            start = words.starts[a:b]
            base, end = start[0], min(start[-1] + words.lengths[b - 1], len(words.trigram))
            total = np.zeros((end - base + 1, CHAR_DIM))
            np.cumsum(self.p["char"][words.trigram[base:end]], axis=0, out=total[1:])
            stop = np.minimum(start + words.lengths[a:b], end)
            row[a - first : b - first], out = some, x[a - first : b - first]
            out[:, 0], out[:, 1 : 1 + WORD_DIM] = self.odds[some], self.p["word"][some]
            out[:, 1 + WORD_DIM :] = (total[stop - base] - total[start - base]) / words.lengths[a:b, None]
        return row, x

    def projected(self, x: np.ndarray) -> list[np.ndarray]:
        x = x if len(x) else np.zeros((1, INPUT), F32)
        return [x @ self.p["wx"][d] + self.p["b"][d] for d in (0, 1)]

    def forward(self, projected: list[np.ndarray], places: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window; with ``keep``, what the way back needs."""
        n, p = len(places), self.p
        states, steps = np.zeros((WINDOW, n, 2 * HIDDEN), F32), []
        m = mask.astype(F32)
        for d in (0, 1):
            h = np.zeros((n, HIDDEN), F32)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g, r = projected[d][places[:, t]], h @ p["wh"][d]
                a = g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN]
                gate = 0.5 + 0.5 * squash(a)
                z, reset = gate[:, :HIDDEN], gate[:, HIDDEN:]
                c = g[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :]
                new = squash(c)
                old = h
                h = h + m[:, t, None] * (1 - z) * (new - h)
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
                if keep:
                    steps.append((d, t, old, r, a, z, reset, c, new))
        e = squash(states @ p["wa"])
        s = np.where(mask.T, e @ p["va"], F32(-30))
        alpha = np.exp(s - s.max(axis=0)) * mask.T
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, (states, steps, e, alpha, pooled)) if keep else logit

    def gradients(self, words: Words, row: np.ndarray, x: np.ndarray, places: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        p, at = self.p, places
        x, places = x[places.ravel()], np.arange(places.size).reshape(places.shape)
        projected = self.projected(x)
        logit, (states, steps, e, alpha, pooled) = self.forward(projected, places, mask, keep=True)
        d_logit = ((1 / (1 + np.exp(-logit))) - y).astype(F32) / len(y)
        out = {k: np.zeros_like(v) for k, v in p.items()}
        out["wo"], out["bo"] = d_logit @ pooled, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["wo"]
        d_alpha = (states * d_pooled).sum(axis=2)
        d_s = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        out["va"] = np.einsum("tn,tnk->k", d_s, e)
        d_e = d_s[:, :, None] * p["va"] * np.square(1 - np.abs(e))  # squash' = (1 - |squash|)^2
        out["wa"] = np.einsum("tnh,tnk->hk", states, d_e)
        d_states = alpha[:, :, None] * d_pooled + d_e @ p["wa"].T
        d_x = np.zeros((len(places), WINDOW, INPUT), F32)
        d_h, last, m = np.zeros((len(places), HIDDEN), F32), None, mask.astype(F32)
        for d, t, old, r, a, z, reset, c, new in reversed(steps):
            if d != last:
                d_h, last = np.zeros_like(d_h), d
            d_h = d_h + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            mt = m[:, t, None]
            d_new, d_z = d_h * mt * (1 - z), -d_h * mt * (new - old)
            d_c = d_new * slope(c)
            d_a = np.concatenate([d_z, d_c * r[:, 2 * HIDDEN :]], axis=1) * 0.5 * slope(a)
            d_r = np.concatenate([d_a, d_c * reset], axis=1)
            d_g = np.concatenate([d_a, d_c], axis=1)
            out["wh"][d] += old.T @ d_r
            out["b"][d] += d_g.sum(axis=0)
            out["wx"][d] += x[places[:, t]].T @ d_g
            d_x[:, t] += d_g @ p["wx"][d].T
            d_h = d_h * (1 - mt * (1 - z)) + d_r @ p["wh"][d].T
        d_x, at = d_x[mask], at[mask]
        np.add.at(out["word"], row[at], d_x[:, 1 : 1 + WORD_DIM])
        each = words.lengths[at]
        tri = np.minimum(K.ragged(words.starts[at], each), len(words.trigram) - 1)
        np.add.at(out["char"], words.trigram[tri], np.repeat(d_x[:, 1 + WORD_DIM :] / each[:, None], each, axis=0))
        out["word"][-1] = 0
        return out

    def windows(self, words: Words) -> np.ndarray:
        """Logits of all windows, in runs whose words are projected together."""
        out = np.zeros(len(words.first), F32)
        for i in range(0, len(out), _LANES):
            some = np.arange(i, min(i + _LANES, len(out)))
            places, mask = words.places(some)
            lo, hi = int(words.first[some[0]]), int(words.first[some[-1]] + words.left[some[-1]])
            out[some] = self.forward(self.projected(self.inputs(words, lo, hi)[1]), np.where(mask, places - lo, 0), mask)
        return out

    def strongest(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(logit, window) of each text's strongest window; the bias for texts without words."""
        logits = self.windows(words)
        best, where = np.full(len(words.count), self.p["bo"][0], np.float64), np.full(len(words.count), -1)
        some = np.flatnonzero(words.count)
        if len(some):
            order = np.lexsort((-logits, np.repeat(np.arange(len(words.count)), words.count)))
            where[some] = order[words.to[:-1][some]]
            best[some] = logits[where[some]]
        return best, where

    def score(self, words: Words) -> np.ndarray:
        if not self.fitted:
            return np.full(len(words.count), self.share)
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-(a * self.strongest(words)[0] + b * np.log1p(words.count) + c)))


def train(texts: pa.Array, y: np.ndarray) -> Network:
    """Fits a network to texts and their 0/1 labels."""
    data, off = K.text_buffer(texts)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Network(np.zeros(1, np.uint64), np.zeros(2), share)
    rng = np.random.default_rng(11)
    apart = rng.permutation(len(y)) % 4 == 0
    words = Words(data, off)
    text = np.repeat(np.arange(len(y)), np.diff(words.at))
    fits = ~apart[text]
    order = np.lexsort((text[fits], words.hash[fits]))
    h, of = words.hash[fits][order], text[fits][order]
    once = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]  # each word once a text
    vocabulary, which, seen = np.unique(h[once], return_inverse=True, return_counts=True)
    ones = np.bincount(which, y[of[once]], len(vocabulary))
    n1, n0 = y[~apart].sum(), (1 - y[~apart]).sum()
    odds = np.log((ones + 0.5) / (n1 + 1)) - np.log((seen - ones + 0.5) / (n0 + 1))
    odds *= seen / (seen + 4.0)
    often = seen >= LEAST_TEXTS
    net = Network(vocabulary[often] if often.any() else np.zeros(1, np.uint64), np.r_[odds[often] if often.any() else [0.0], 0.0] / 2, share)
    fit_texts = np.flatnonzero(~apart & (words.count > 0))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    rounds = min(40, max(ROUNDS, STEPS * BATCH // (2 * len(fit_texts))))  # small samples have few steps a round
    for _ in range(rounds):
        row, x = net.inputs(words)  # they move slowly within a round
        _, where = net.strongest(words)
        zero = fit_texts[y[fit_texts] == 0]
        window = np.r_[where[fit_texts], words.to[zero] + (rng.random(len(zero)) * words.count[zero]).astype(np.int64)]
        label = np.r_[y[fit_texts], np.zeros(len(zero))]
        order = rng.permutation(len(window))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            grads = net.gradients(words, row, x, *words.places(window[some]), label[some])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + DECAY * net.p[k]).astype(F32)
    # Calibration on the texts kept apart: ridged logistic regression on standardised inputs, by Newton steps that must not do worse.
    z = np.stack([net.strongest(words)[0], np.log1p(words.count)], axis=1)
    mean, scale = z[apart].mean(axis=0), z[apart].std(axis=0) + 1e-6
    z, target = np.c_[(z[apart] - mean) / scale, np.ones(apart.sum())], y[apart]
    ridge, w = np.array([0.05, 2.0, 0.01]), np.array([0.0, 0.0, np.log((target.sum() + 1) / (len(target) - target.sum() + 1))])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, z @ v).sum() - target @ (z @ v) + ridge @ v**2 / 2)

    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - target) + ridge * w)
        while loss(w - move) > loss(w) + 1e-9 and np.abs(move).max() > 1e-9:
            move /= 2
        w = w - move
    w = np.r_[w[:2] / scale, w[2] - (w[:2] * mean / scale).sum()]
    net.calibration, net.fitted = w, True
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Network:
    got = labelled_sample(docs, labels, label, rows, FIT_BYTES).select("doc_id", "text", "label_").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(got["text"].combine_chunks() if len(got) else pa.array([], pa.string()), np.array(got["label_"].combine_chunks() if len(got) else [], np.float64))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""

    def score(batches):
        for batch in batches:
            data, off = K.text_buffer(batch.column("text"))
            for i, j in K.slices(off):
                s = net.score(Words(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "held_out": batch.column("held_out").slice(i, j - i), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))

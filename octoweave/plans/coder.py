"""A range coder over integer distributions of total 2**24, for many lanes at once.

64-bit lower bound and range, 32-bit output words, all arithmetic modulo 2**64. Every lane has a stream of its own; one numpy step codes
one symbol of all active lanes. A word whose value a later carry may still change is held back and counted with those after it.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
PRECISION = 24
TOTAL = 1 << PRECISION
_LOW, _FULL = U(0xFFFFFFFF), U(0xFFFFFFFFFFFFFFFF)
_32 = U(32)


def integer_cdf(weights: np.ndarray) -> np.ndarray:
    """(rows, K + 1) bounds with a mass of at least 1 for each symbol, for rows of integer or float weights; rows without a finite positive
    sum become uniform. Integer weights give the same bounds on every machine."""
    w = np.atleast_2d(weights)
    k = w.shape[1]
    if w.dtype.kind == "f":
        total = w.sum(axis=1, keepdims=True)
        bad = ~(np.isfinite(total) & (total > 0))
        share = np.cumsum(np.where(bad, 1.0, w), axis=1) / np.where(bad, float(k), total)
        inner = np.floor((TOTAL - k) * np.minimum(share, 1.0)).astype(np.int64)
    else:
        w = w.astype(np.int64)
        while (most := int(w.sum(axis=1).max(initial=0))) > 1 << 38:
            w = w >> max(1, most.bit_length() - 38)
        total = w.sum(axis=1, keepdims=True)
        w = np.where(total > 0, w, 1)
        inner = (TOTAL - k) * np.cumsum(w, axis=1) // w.sum(axis=1, keepdims=True)
    out = np.zeros((len(w), k + 1), np.int64)
    out[:, 1:] = inner + np.arange(1, k + 1)
    out[:, -1] = TOTAL
    return out.astype(np.uint64)


class Encoder:
    def __init__(self, lanes: int, most: int):
        """``most``: symbols of the longest lane."""
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
        self.held, self.first = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint64)
        self.words, self.at = np.zeros((lanes, most + 4), np.uint32), np.zeros(lanes, np.int64)
        self.coded = np.zeros(lanes, bool)

    def _emit(self, lanes: np.ndarray, word: np.ndarray) -> None:
        if len(lanes):
            if int(self.at[lanes].max()) + 1 >= self.words.shape[1]:
                self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            self.words[lanes, self.at[lanes]] = word.astype(np.uint32)
            self.at[lanes] += 1

    def _flush(self, lanes: np.ndarray, carry: np.ndarray) -> None:
        self._emit(lanes, self.first[lanes] + carry.astype(np.uint64))
        rest = self.held[lanes] - 1
        while len(lanes) and (more := rest > 0).any():
            lanes, carry, rest = lanes[more], carry[more], rest[more] - 1
            self._emit(lanes, np.where(carry, U(0), _LOW))

    def step(self, n: int, lo: np.ndarray, hi: np.ndarray) -> None:
        """Codes the interval [lo, hi) in each of the first n lanes."""
        low, q = self.low[:n], self.range[:n] >> U(PRECISION)
        new = low + q * lo
        carry = new < low
        span = q * (hi - lo)
        self.coded[:n] = True
        settled = np.flatnonzero((self.held[:n] > 0) & (new + span >= new))
        if len(settled):
            self._flush(settled, carry[settled])
            self.held[settled] = 0
        small = np.flatnonzero(span <= _LOW)
        if len(small):
            top = new[small] >> _32
            new[small] <<= _32
            span[small] <<= _32
            waits = self.held[small] > 0
            self.held[small[waits]] += 1
            rest, top = small[~waits], top[~waits]
            wraps = new[rest] + span[rest] < new[rest]
            self._emit(rest[~wraps], top[~wraps])
            self.held[rest[wraps]], self.first[rest[wraps]] = 1, top[wraps]
        self.low[:n], self.range[:n] = new, span

    def finish(self) -> list[np.ndarray]:
        """The words of each lane; none where nothing was coded."""
        point = self.low + _LOW
        wrapped = point < self.low
        held = np.flatnonzero(self.held > 0)
        self._flush(held, wrapped[held])
        done = np.flatnonzero(self.coded)
        self._emit(done, point[done] >> _32)
        more = done[((self.low + self.range)[done] >> _32) == (point[done] >> _32)]
        self._emit(more, np.zeros(len(more), np.uint64))
        return [w[:n].copy() for w, n in zip(self.words, self.at)]


class Decoder:
    def __init__(self, streams: list[np.ndarray]):
        n = len(streams)
        self.words = np.zeros((n, max((len(s) for s in streams), default=0) + 3), np.uint64)  # words past the end read as 0
        for row, s in zip(self.words, streams):
            row[: len(s)] = s
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, _FULL)
        self.point = (self.words[:, 0] << _32) | self.words[:, 1]
        self.at = np.full(n, 2)

    def target(self, n: int) -> np.ndarray:
        """Where in 0..TOTAL - 1 each of the first n lanes points."""
        return np.minimum((self.point[:n] - self.low[:n]) // (self.range[:n] >> U(PRECISION)), U(TOTAL - 1))

    def step(self, n: int, lo: np.ndarray, hi: np.ndarray) -> None:
        """Takes the interval [lo, hi) that holds the target."""
        q = self.range[:n] >> U(PRECISION)
        self.low[:n] += q * lo
        self.range[:n] = q * (hi - lo)
        small = np.flatnonzero(self.range[:n] <= _LOW)
        if len(small):
            self.low[small] <<= _32
            self.range[small] <<= _32
            self.point[small] = (self.point[small] << _32) | self.words[small, np.minimum(self.at[small], self.words.shape[1] - 1)]
            self.at[small] += 1

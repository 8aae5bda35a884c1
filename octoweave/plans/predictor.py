"""Next-byte predictors. A predictor gives, for many lanes at once, the integer bounds of the next symbol's distribution.

Protocol: ``symbols``; ``start(lanes)`` returns a state; ``bounds(state, previous)`` takes the first len(previous) lanes' last symbols and
returns (lanes, symbols + 1) bounds of total 2**24, moving the state on; ``to_bytes()`` names it.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
from pyspark.sql import DataFrame

from ..functions.scalars import fingerprint
from ..operators.counts import byte_counts, pair_counts
from .coder import PRECISION, integer_cdf


class CountModel:
    """Order 0 or 1: add-one smoothed counts in integers, so that every machine makes the same bounds."""

    def __init__(self, counts: np.ndarray):
        """(contexts, symbols) counts: one context for order 0, a context for each symbol for order 1."""
        self.counts = np.asarray(counts, np.int64)
        self.symbols = self.counts.shape[1]
        self.cdf = integer_cdf(self.counts + 1)
        # The symbol at each 1/256 of the range: where a search for a target begins and ends.
        marks = np.arange(257, dtype=np.uint64) << np.uint64(PRECISION - 8)
        self.marks = np.stack([np.minimum(np.searchsorted(row, marks, "right") - 1, self.symbols - 1) for row in self.cdf])

    def start(self, lanes: int):
        return None

    def rows(self, previous: np.ndarray) -> np.ndarray:
        return previous if len(self.cdf) > 1 else np.zeros(len(previous), np.int64)

    def bounds(self, state, previous: np.ndarray) -> np.ndarray:
        return self.cdf[self.rows(previous)]

    def find(self, row: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The symbol whose interval holds each target, in the given contexts."""
        mark = (target >> np.uint64(PRECISION - 8)).astype(np.int64)
        lo, hi = self.marks[row, mark], self.marks[row, mark + 1] + 1
        while True:
            open_ = np.flatnonzero(hi - lo > 1)
            if not len(open_):
                return lo
            a, b = lo[open_], hi[open_]
            middle = (a + b) >> 1
            right = self.cdf[row[open_], middle] <= target[open_]
            lo[open_], hi[open_] = np.where(right, middle, a), np.where(right, b, middle)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.save(out, self.counts)
        return zlib.compress(out.getvalue(), 9)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountModel:
        return cls(np.load(io.BytesIO(zlib.decompress(data))))

    @property
    def fingerprint(self) -> bytes:
        return fingerprint(self.to_bytes())


def train_counts(docs: DataFrame, order: int = 1, data: str = "data", symbols: int = 256) -> CountModel:
    """Counts of all values' bytes (symbols below ``symbols``); at most 65,536 numbers reach the driver."""
    if order == 0:
        rows = byte_counts(docs, data).collect()
        table = np.zeros((1, symbols), np.int64)
        for r in rows:
            table[0, r["byte"]] = r["n"]
        return CountModel(table)
    table = np.zeros((symbols, symbols), np.int64)
    for r in pair_counts(docs, data).collect():
        table[r["ctx"], r["byte"]] = r["n"]
    return CountModel(table)

"""Distributed fitting of the state-space predictor's output layer: gradients are summed where the chunks are, steps taken on the driver.

The recurrent part keeps its weights; the output layer is a softmax regression on its states. Each epoch is one pass over the chunk rows
whose tasks send one matrix each; sums over tasks are an aggregation of 256 x width numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ssm import StateSpace, product, softmax

LANES = 512


def hidden(model: StateSpace, state: list[dict], symbol: np.ndarray) -> np.ndarray:
    """What the output layer reads, one step."""
    whole = dict(model.w)
    eye = np.eye(model.d_model, dtype=np.float32)
    probe = StateSpace(whole | {"head2.w": eye, "head2.b": np.zeros(model.d_model, np.float32)}, model.d_model, model.layers, model.symbols)
    return probe.step(state, symbol)


def _sums(model: StateSpace, data: str):
    def sums(batches):
        total, loss, n = np.zeros((model.symbols, model.d_model + 1)), 0.0, 0
        for batch in batches:
            lanes = sorted((np.frombuffer(b or b"", np.uint8) for b in batch.column(data).to_pylist()), key=len, reverse=True)
            for i in range(0, len(lanes), LANES):
                some = [x for x in lanes[i : i + LANES] if len(x) > 1]
                if not some:
                    continue
                state = model.start(len(some))
                for t in range(len(some[0]) - 1):
                    live = [x for x in some if len(x) > t + 1]
                    h = hidden(model, state, np.array([x[t] for x in live]))
                    p = softmax(product(h, model.w["head2.w"]) + model.w["head2.b"]).astype(np.float64)
                    y = np.array([x[t + 1] for x in live])
                    loss -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).sum()
                    p[np.arange(len(y)), y] -= 1
                    total += p.T @ np.c_[h, np.ones(len(h))]
                    n += len(y)
        yield pa.record_batch({"cell": np.arange(total.size), "g": total.ravel(), "loss": np.full(total.size, loss), "n": np.full(total.size, n)})

    return sums


def fit_head(chunks: DataFrame, model: StateSpace, epochs: int = 3, rate: float = 0.5, data: str = "data") -> tuple[StateSpace, list[float]]:
    """(model, bits a byte before each epoch)."""
    curve = []
    for _ in range(epochs):
        rows = chunks.select(data).mapInArrow(_sums(model, data), "cell long, g double, loss double, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).orderBy("cell").toPandas()
        n = max(1, int(rows["n"].iloc[0])) if len(rows) else 1
        curve.append(float(rows["loss"].iloc[0]) / n / math.log(2) if len(rows) else 0.0)
        g = (rows["g"].to_numpy() / n).reshape(model.symbols, model.d_model + 1).astype(np.float32)
        w = dict(model.w)
        w["head2.w"], w["head2.b"] = w["head2.w"] - rate * g[:, :-1], w["head2.b"] - rate * g[:, -1]
        model = StateSpace(w, model.d_model, model.layers, model.symbols)
    return model, curve

"""A selective state-space byte predictor in numpy, stepped one symbol at a time with constant state.

Blocks: x + FF(LN(SSM(LN(x)))); the state-space layer has an input projection to two streams, a causal depthwise convolution, a selective
recurrence and a gate. A sequence is read by stepping, so that the sequence and the streaming forms are one computation and agree bit for bit.
"""

from __future__ import annotations

import math

import numpy as np

from ..functions.scalars import fingerprint
from .coder import integer_cdf

STATES, EXPAND, CONV = 16, 2, 4
F32 = np.float32


def shapes(d_model: int, layers: int, symbols: int) -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes in the order of a flat weight file."""
    inner, rank = EXPAND * d_model, math.ceil(d_model / 16)
    out = [("embedding", (symbols, d_model))]
    for i in range(layers):
        out += [(f"{i}.{name}", shape) for name, shape in (
            ("ln1.w", (d_model,)), ("ln1.b", (d_model,)), ("in.w", (2 * inner, d_model)), ("in.b", (2 * inner,)), ("conv.w", (inner, CONV)), ("conv.b", (inner,)),
            ("x.w", (rank + 2 * STATES, inner)), ("dt.w", (inner, rank)), ("dt.b", (inner,)), ("a_log", (inner, STATES)), ("d", (inner,)), ("out.w", (d_model, inner)), ("out.b", (d_model,)),
            ("ln2.w", (d_model,)), ("ln2.b", (d_model,)), ("ff0.w", (4 * d_model, d_model)), ("ff0.b", (4 * d_model,)), ("ff2.w", (d_model, 4 * d_model)), ("ff2.b", (d_model,)),
        )]
    return out + [("head0.w", (d_model, d_model)), ("head0.b", (d_model,)), ("head2.w", (symbols, d_model)), ("head2.b", (symbols,))]


def split_flat(flat: np.ndarray, d_model: int, layers: int, symbols: int) -> dict[str, np.ndarray]:
    at, out = 0, {}
    for name, shape in shapes(d_model, layers, symbols):
        size = math.prod(shape)
        out[name] = flat[at : at + size].reshape(shape).astype(F32)
        at += size
    if at != len(flat):
        raise ValueError(f"{len(flat)} weights where {at} are needed")
    return out


def random_weights(d_model: int, layers: int, symbols: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in shapes(d_model, layers, symbols):
        kind = name.split(".", 1)[-1]
        if kind in ("ln1.w", "ln2.w", "d"):
            out[name] = np.ones(shape, F32)
        elif kind == "a_log":
            out[name] = np.log(np.tile(np.arange(1, STATES + 1, dtype=F32), (shape[0], 1)))
        elif kind.endswith(".b"):
            out[name] = np.zeros(shape, F32)
        else:
            out[name] = (rng.normal(size=shape) / math.sqrt(shape[-1])).astype(F32)
    return out


def layer_norm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    mean = x.mean(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(np.square(x - mean).mean(axis=-1, keepdims=True) + F32(1e-5)) * w + b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(1) / (F32(1) + np.exp(-np.clip(x, -88, 88)))


def silu(x: np.ndarray) -> np.ndarray:
    return x * sigmoid(x)


def gelu(x: np.ndarray) -> np.ndarray:
    """By the tanh approximation."""
    return F32(0.5) * x * (F32(1) + np.tanh(F32(math.sqrt(2 / math.pi)) * (x + F32(0.044715) * x * x * x)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x, F32(0))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x w^T, each row summed by itself in one order, so that a lane's result does not depend on the lanes beside it."""
    return np.einsum("ij,kj->ik", x, w, optimize=False)


class StateSpace:
    """The predictor protocol over lanes; one state array for each layer."""

    def __init__(self, weights: dict[str, np.ndarray], d_model: int, layers: int, symbols: int = 256):
        self.w, self.d_model, self.layers, self.symbols = weights, d_model, layers, symbols
        self.inner, self.rank = EXPAND * d_model, math.ceil(d_model / 16)

    def start(self, lanes: int) -> list[dict]:
        return [{"conv": np.zeros((lanes, self.inner, CONV), F32), "h": np.zeros((lanes, self.inner, STATES), F32)} for _ in range(self.layers)]

    def _layer(self, x: np.ndarray, i: int, state: dict) -> np.ndarray:
        w, n = (lambda name: self.w[f"{i}.{name}"]), len(x)
        u, z = np.split(product(x, w("in.w")) + w("in.b"), 2, axis=1)
        conv = state["conv"][:n]
        conv[:, :, :-1] = conv[:, :, 1:].copy()
        conv[:, :, -1] = u
        u = silu((conv * w("conv.w")).sum(axis=2) + w("conv.b"))
        dt, b, c = np.split(product(u, w("x.w")), [self.rank, self.rank + STATES], axis=1)
        dt = softplus(product(dt, w("dt.w")) + w("dt.b"))
        h = state["h"][:n]
        h *= np.exp(-np.exp(w("a_log")) * dt[:, :, None])
        h += (dt * u)[:, :, None] * b[:, None, :]
        y = (h * c[:, None, :]).sum(axis=2) + w("d") * u
        return product(y * silu(z), w("out.w")) + w("out.b")

    def step(self, state: list[dict], symbol: np.ndarray) -> np.ndarray:
        """Logits of the next symbol of the first len(symbol) lanes."""
        x = self.w["embedding"][symbol]
        for i in range(self.layers):
            y = self._layer(layer_norm(x, self.w[f"{i}.ln1.w"], self.w[f"{i}.ln1.b"]), i, state[i])
            y = layer_norm(y, self.w[f"{i}.ln2.w"], self.w[f"{i}.ln2.b"])
            y = product(gelu(product(y, self.w[f"{i}.ff0.w"]) + self.w[f"{i}.ff0.b"]), self.w[f"{i}.ff2.w"]) + self.w[f"{i}.ff2.b"]
            x = x + y
        x = np.maximum(product(x, self.w["head0.w"]) + self.w["head0.b"], 0)
        return product(x, self.w["head2.w"]) + self.w["head2.b"]

    def forward(self, sequences: np.ndarray) -> np.ndarray:
        """(lanes, length, symbols) logits."""
        state = self.start(len(sequences))
        return np.stack([self.step(state, s) for s in sequences.T], axis=1)

    def bounds(self, state: list[dict], previous: np.ndarray) -> np.ndarray:
        return integer_cdf(softmax(self.step(state, previous)).astype(np.float64))

    def to_bytes(self) -> bytes:
        return b"".join(np.ascontiguousarray(self.w[name], "<f4").tobytes() for name, _ in shapes(self.d_model, self.layers, self.symbols))

    @property
    def fingerprint(self) -> bytes:
        return fingerprint(self.to_bytes())


def load_flat(path: str, d_model: int, layers: int, symbols: int = 256) -> StateSpace:
    return StateSpace(split_flat(np.fromfile(path, "<f4"), d_model, layers, symbols), d_model, layers, symbols)


def save_flat(model: StateSpace, path: str) -> None:
    with open(path, "wb") as f:
        f.write(model.to_bytes())


def lanes_for(memory_bytes: int, d_model: int, layers: int, symbols: int = 256, chunk: int = 4096) -> tuple[int, int]:
    """(lanes, chunk length) whose state, logits and symbols fit nine tenths of the memory: lanes are halved first, then the chunk."""
    inner = EXPAND * d_model
    each = layers * inner * (STATES + CONV) * 4 + (4 * d_model + 4 * inner + 3 * symbols) * 8
    lanes = 8192
    while lanes > 1 and lanes * (each + chunk * 8) > 0.9 * memory_bytes:
        lanes //= 2
    while chunk > 256 and lanes * (each + chunk * 8) > 0.9 * memory_bytes:
        chunk //= 2
    return lanes, chunk


def reproducible_exp(x: np.ndarray) -> np.ndarray:
    """exp in single precision by range reduction and a degree-6 polynomial, from elementary operations only: the same on every machine."""
    x = np.clip(np.asarray(x, F32), F32(-88), F32(88))
    k = np.rint(x * F32(1 / math.log(2)))
    r = x - k * F32(0.693359375) + k * F32(2.12194440e-4)
    p = F32(1 / 720)
    for c in (1 / 120, 1 / 24, 1 / 6, 1 / 2, 1, 1):
        p = p * r + F32(c)
    return np.ldexp(p, k.astype(np.int32))

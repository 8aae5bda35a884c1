"""Vectorised numpy kernels over the bytes of many texts at once.

Every kernel works on one contiguous byte buffer with document offsets, so its cost follows the bytes and never the number of
words in Python. Buffers are cut into slices of about ``SLICE_BYTES``; a single longer text is one slice of its own, whose words are found
and hashed in pieces of ``PIECE_BYTES``, so that what stays in memory is a few numbers for each word and not for each byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles at once: small enough for the cache and for two workers an executor.
SLICE_BYTES = 1 << 20
#: Bytes whose words are found, or hashed, at once.
PIECE_BYTES = 4 << 20

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit value for each byte.
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0xD1342543DE82EF95)
_BASE_INV = U(pow(0xD1342543DE82EF95, -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII letters and digits, and every byte above 0x7F, belong to words; A-Z fold to a-z.
IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
FOLDED_CODE = BYTE_CODE[FOLD]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    for i, base in enumerate((_BASE, _BASE_INV)):
        p = _POWERS[i]
        while len(p) < n:
            step = U(pow(int(base), len(p), 2**64))
            p = np.concatenate([p, p * step])
        _POWERS[i] = p
    return _POWERS[0][:n], _POWERS[1][:n]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.binary())
    column = pc.fill_null(column.cast(pa.binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last + 1) of document runs that hold about ``limit`` bytes, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, off: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the offsets of each document's words among them; ``word``: which bytes belong to words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    parts = []
    for a in range(0, n, PIECE_BYTES):
        b = min(a + PIECE_BYTES, n)
        w = IS_WORD[data[max(a - 1, 0) : b + 1]] if word is None else word[max(a - 1, 0) : b + 1]
        before, after = w[:1] if a else np.zeros(1, bool), w[-1:] if b < n else np.zeros(1, bool)
        w = w[int(a > 0) :][: b - a]
        edge = np.zeros(b - a + 1, bool)
        edge[off[np.searchsorted(off, a) : np.searchsorted(off, b, "right")] - a] = True
        parts.append((np.flatnonzero(w & (np.r_[~before, ~w[:-1]] | edge[:-1])) + a, np.flatnonzero(w & (np.r_[~w[1:], ~after] | edge[1:])) + a + 1))
    starts, ends = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts))
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = FOLDED_CODE) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal content at any place (of letters folded to lower case, by default)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) <= PIECE_BYTES:
        return _span_hashes(data, starts, ends, code)
    out = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > PIECE_BYTES // 4)
    for i in long.tolist():
        out[i] = _long_hash(data, int(starts[i]), int(ends[i]), code)
    rest = np.setdiff1d(np.arange(len(starts)), long) if len(long) else np.arange(len(starts))
    i = 0
    while i < len(rest):  # spans come in order, and none here is long
        base = int(starts[rest[i]])
        j = i + int(np.searchsorted(starts[rest[i:]], base + PIECE_BYTES // 2, "right"))
        some = rest[i:j]
        out[some] = _span_hashes(data[base : int(ends[some].max())], starts[some] - base, ends[some] - base, code)
        i = j
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _long_hash(data: np.ndarray, start: int, end: int, code: np.ndarray) -> np.uint64:
    """The same hash of one long span, a piece at a time."""
    total, up = 0, powers(PIECE_BYTES)[0]
    for a in range(start, end, PIECE_BYTES):
        piece = data[a : min(a + PIECE_BYTES, end)]
        total += int((code[piece] * up[: len(piece)]).sum(dtype=np.uint64)) * pow(int(_BASE), a - start, 2**64)
    return mix64(np.array([(total + end - start) % 2**64], np.uint64))[0]


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, in order, and the offsets of each document's words."""
    starts, ends, at = word_spans(data, off)
    return span_hashes(data, starts, ends), at


def shingles_of(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a document, and the offsets of each document's runs.

    A document of fewer words has none.
    """
    counts = np.maximum(np.diff(at) - size + 1, 0)
    to = np.r_[0, np.cumsum(counts)]
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    h = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        h = h * U(0x9E3779B97F4A7C15) + words[j : len(words) - size + 1 + j]
    place = np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], counts)
    return mix64(h[place]), to


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then from starts[1], and so on."""
    to = np.cumsum(counts)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - counts), counts)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def pack_ints(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_ints(b: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()

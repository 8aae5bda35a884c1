"""Scalar expressions on columns (built-in functions only) and their driver-side twins."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_of(data: Column) -> Column:
    """The bytes of a BINARY as an array of 0..255."""
    return F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))


def uvarint_length(x: Column) -> Column:
    """Bytes of x as a variable-length integer of 7-bit groups."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / F.lit(7.0))).cast("int")


def uvarint(x: int) -> bytes:
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes(out + bytes([x]))


def read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it)."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def words_le(words: np.ndarray) -> bytes:
    """32-bit words, little-endian."""
    return np.ascontiguousarray(words, "<u4").tobytes()


def held(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it, also within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, stable by subtracting the largest. Largest and sum are worked out once for an array, so that
    its cost follows its length."""
    exps = held(logits, lambda v: held(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp(x - most))))
    return held(exps, lambda e: held(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total)))


def bits(nats: Column) -> Column:
    return nats / math.log(2)


def ratio_of_bits(bits_per_byte: Column) -> Column:
    """Compression ratio that so many bits a byte make."""
    return F.when(bits_per_byte > 0, 8 / bits_per_byte).otherwise(F.lit(float("inf")))


def ratio(original: Column, compressed: Column) -> Column:
    return F.when(compressed > 0, original / compressed).otherwise(F.lit(float("inf")))


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, '.', '_' and '-': others become one '_', cut to 64."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-z._-]", "_"), "_+", "_"), 1, 64)


def root_to_https(url: Column, host: str) -> Column:
    """root://server//path as https://host/path; other addresses as they are."""
    return F.when(url.startswith("root://"), F.concat(F.lit(f"https://{host}/"), F.regexp_replace(url, "^root://[^/]+/+", ""))).otherwise(url)


def spectrum(k: Column, peak: float) -> Column:
    """Energy of wave number k: k^4 exp(-2 (k / peak)^2) k^(-5/3), 0 at 0."""
    return F.when(k > 0, F.pow(k, F.lit(4.0)) * F.exp(-2 * F.pow(k / peak, F.lit(2.0))) * F.pow(k, F.lit(-5.0 / 3.0))).otherwise(0.0)


def magnitude(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def fingerprint(data: bytes) -> bytes:
    """16 bytes that name a model by its contents."""
    return hashlib.blake2s(data, digest_size=16).digest()

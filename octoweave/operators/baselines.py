"""Sizes that general-purpose codecs make of the same bytes."""

from __future__ import annotations

import lzma
import time
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio



def _lzma(data: bytes) -> bytes:
    """Preset 9 extreme, with a dictionary no larger than the value: the preset's 64 MiB are cleared anew for each value, and take ten times that."""
    size = min(1 << 26, max(1 << 12, 1 << max(len(data) - 1, 0).bit_length()))
    return lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME, "dict_size": size}])


CODECS = {"zlib": lambda b: zlib.compress(b, 9), "lzma": _lzma}


def baseline_sizes(chunks: DataFrame, data: str = "data", codecs: tuple[str, ...] = ("zlib", "lzma")) -> DataFrame:
    """(codec, n, original, compressed, ratio, seconds) over all values, each compressed by itself."""

    def squeeze(batches):
        for batch in batches:
            rows = []
            for codec in codecs:
                began, values = time.perf_counter(), batch.column(data).to_pylist()
                sizes = [len(CODECS[codec](b or b"")) for b in values]
                rows.append((codec, len(values), sum(len(b or b"") for b in values), sum(sizes), time.perf_counter() - began))
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["codec", "n", "original", "compressed", "seconds"])

    parts = chunks.select(data).mapInArrow(squeeze, "codec string, n long, original long, compressed long, seconds double")
    total = parts.groupBy("codec").agg(*(F.sum(c).alias(c) for c in ("n", "original", "compressed", "seconds")))
    return total.withColumn("ratio", ratio(F.col("original"), F.col("compressed")))

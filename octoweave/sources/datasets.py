"""Dataset preparation: flat binaries with their sidecar, dtype descriptions, optional fields, prefixes, archives and a synthetic field."""

from __future__ import annotations

import json
import os
import tarfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import spectrum
from ..operators.records import SIDECAR, padded, sidecar

#: Bytes of a training prefix: 200 MiB.
PREFIX_BYTES = 200 * 1024 * 1024

_TO_SPARK = {"f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "b1": T.BooleanType()}
_TO_NUMPY = {"float": "<f4", "double": "<f8", "tinyint": "|i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "boolean": "|b1"}


def schema_of_descr(text: str) -> T.StructType:
    """A record description ([name, type] or [name, type, shape] lists, as JSON) as a schema; shaped fields are arrays that keep their shape
    as metadata."""
    out = T.StructType()
    for name, kind, *shape in json.loads(text):
        plain = _TO_SPARK[kind.lstrip("<>|=")]
        for _ in shape[0] if shape else ():
            plain = T.ArrayType(plain)
        out.add(name, plain, metadata={"shape": shape[0]} if shape else None)
    return out


def descr_of_schema(schema: T.StructType) -> str:
    """The way back; an array without a shape has one of unknown lengths, -1."""
    out = []
    for f in schema:
        kind, depth = f.dataType, 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        shape = list((f.metadata or {}).get("shape", [-1] * depth))
        out.append([f.name, _TO_NUMPY[kind.simpleString()], *([shape] if depth else [])])
    return json.dumps(out)


def stacked(fields: list[Column]) -> Column:
    """Fields as one array, in the order of the last axis; flatten arrays of these for row-major data."""
    return F.array(*fields)


def present(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that there are, in order; of arrays the first element."""
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.select(*(F.get(c, F.lit(0)).alias(c) if isinstance(kinds[c], T.ArrayType) else F.col(c) for c in wanted if c in kinds))


def normalised(rows: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Columns shifted to mean 0 and scaled to the given population deviations; constant columns become 0."""
    stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in targets for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return rows.withColumns({c: (F.col(c) - stats[f"m_{c}"]) * ((target / stats[f"s_{c}"]) if stats[f"s_{c}"] else 0.0) for c, target in targets.items()})


def write_binary(rows: DataFrame, array: str, order: str, path: str, kind: str = "<f4") -> int:
    """An array column's numbers in order as one flat file, a row at a time; returns its bytes."""
    size = 0
    with open(path, "wb") as f:
        for r in rows.select(order, array).orderBy(order).toLocalIterator():
            size += f.write(np.asarray(r[array], kind).tobytes())
    return size


def write_events(events: DataFrame, names: list[str], key: str, folder: str) -> dict:
    """Padded rows as Parquet, and their sidecar as JSON beside them."""
    meta = sidecar(events, names)
    padded(events, meta, key).write.parquet(os.path.join(folder, "rows"))
    with open(os.path.join(folder, "meta.json"), "w", encoding="utf-8") as f:
        json.dump(meta, f)
    return meta


def read_events(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    rows = spark.read.parquet(os.path.join(folder, "rows"))
    with open(os.path.join(folder, "meta.json"), encoding="utf-8") as f:
        meta = json.load(f)
    if rows.count() != meta["n_events"]:
        raise ValueError("the rows are not as many as the sidecar says")
    return rows, meta


def parsed_sidecar(column: Column) -> Column:
    return F.from_json(column, SIDECAR)


def copy_prefix(source: str, target: str, most: int = PREFIX_BYTES, piece: int = 1 << 20) -> int:
    """The first bytes of a file, in pieces."""
    left = most
    with open(source, "rb") as a, open(target, "wb") as b:
        while left > 0 and (data := a.read(min(piece, left))):
            left -= b.write(data)
    return most - left


def extract(archive: str, folder: str) -> list[str]:
    """Unpacks a tar archive, compressed or not; members that would land elsewhere, and links, are refused."""
    root, out = os.path.realpath(folder), []
    with tarfile.open(archive) as tar:
        for m in tar.getmembers():
            where = os.path.realpath(os.path.join(root, m.name))
            if not (where == root or where.startswith(root + os.sep)) or m.issym() or m.islnk():
                raise ValueError(f"{m.name!r} would leave the folder")
        for m in tar.getmembers():
            if m.isfile():
                tar.extract(m, root, filter="data")
                out.append(os.path.join(root, m.name))
    return out


def chosen(paths: list[str], suffixes: tuple[str, ...] = (".hepmc", ".hepmc.gz")) -> str | None:
    """The first file of the first suffix that any has, else the largest."""
    for suffix in suffixes:
        if found := sorted(p for p in paths if p.endswith(suffix)):
            return found[0]
    return max(paths, key=os.path.getsize, default=None)


def turbulence(spark: SparkSession, size: int, peak: float = 4.0, seeds: tuple[int, ...] = (42, 43, 44, 45), names: tuple[str, ...] = ("u", "v", "w", "p")) -> DataFrame:
    """(field, cell, value): random fields on a size**3 grid with a turbulent spectrum. Each field is one inverse transform, so one task."""
    k = np.fft.fftfreq(size) * size
    radius = np.sqrt(sum(x**2 for x in np.meshgrid(k, k, k, indexing="ij"))).ravel()
    energy = {r["k"]: r["e"] for r in spark.createDataFrame([(float(r),) for r in np.unique(radius)], "k double").select("k", spectrum(F.col("k"), peak).alias("e")).collect()}  # one row for each distinct radius of a small grid
    amplitude = np.sqrt(np.vectorize(energy.get)(radius)).reshape(size, size, size)

    def make(batches):
        for batch in batches:
            for name, seed in zip(batch.column("field").to_pylist(), batch.column("seed").to_pylist()):
                phase = np.random.default_rng(seed).uniform(0, 2 * np.pi, amplitude.shape)
                value = np.fft.ifftn(amplitude * np.exp(1j * phase)).real.ravel()
                yield pa.record_batch({"field": pa.array([name] * len(value)), "cell": np.arange(len(value)), "value": value.astype(np.float32)})

    return spark.createDataFrame(list(zip(names, seeds)), "field string, seed int").mapInArrow(make, "field string, cell long, value float")

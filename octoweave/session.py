"""What a Spark session needs before Python tasks can import this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's code to the executors, once for a context, unless their path names it already."""
    sc = spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT.parent) in known or getattr(sc, "_octoweave_shipped", False):
        return spark
    path = Path(tempfile.mkdtemp(prefix="octoweave-")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(path))
    sc._octoweave_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir; a temporary one only where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="octoweave-"))
            at = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = at.get()
    return named.rstrip("/")

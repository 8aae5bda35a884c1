"""Command line: train, compress, decompress, verify, evaluate and compare with general codecs, for one file.

python -m octoweave.cli FILE OUT [flags]; OUT is a folder that gets model, container and decoded file.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import baselines, compare, counts, metrics, splits
from .plans import codec
from .plans.predictor import CountModel, train_counts
from .session import ship
from .sources import config as settings
from .sources import container, ranges


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="octoweave", description=__doc__)
    p.add_argument("file", nargs="?")
    p.add_argument("out", nargs="?", default="out")
    p.add_argument("--config", help="a configuration file, or the name of an experiment")
    p.add_argument("--chunk-size", type=int, dest="seq_size")
    p.add_argument("--max-chunks", type=int, default=0)
    p.add_argument("--order", type=int, choices=(0, 1))
    p.add_argument("--model-path", default=None)
    p.add_argument("--device", help="accepted for the sake of old scripts; everything runs on the cluster's CPUs")
    p.add_argument("--precision", help="as --device; models are integers")
    for flag in ("--train-only", "--compress-only", "--decompress-only", "--verify", "--evaluate", "--evaluate-only", "--comparison-baseline-only", "--show-timings", "--no-progress"):
        p.add_argument(flag, action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    given = {"file_path": args.file, "seq_size": args.seq_size, "order": args.order, "model_path": args.model_path, "device": args.device, "precision": args.precision}
    cfg = settings.load(settings.resolve(args.config), **given) if args.config else settings.Config(**{k: v for k, v in given.items() if v is not None})
    path = cfg.file_to_compress or cfg.file_path
    if not path or not os.path.isfile(path):
        raise FileNotFoundError(f"no file {path!r}")
    if not os.path.getsize(path):
        raise ValueError("the file is empty")
    if cfg.model_path and not os.path.isfile(cfg.model_path):
        raise FileNotFoundError(f"the model {cfg.model_path!r} does not exist")
    spark = ship(spark or SparkSession.builder.getOrCreate())
    os.makedirs(args.out, exist_ok=True)
    model_file, folder, decoded = (os.path.join(args.out, n) for n in ("model.bin", "container", "decoded.bin"))
    out, took, only = {}, {}, args.train_only or args.compress_only or args.decompress_only or args.evaluate_only or args.comparison_baseline_only
    rows = ranges.chunks_of(spark, path, cfg.seq_size, **({"maxChunks": args.max_chunks} if args.max_chunks else {})).select("chunk_id", "data")

    def timed(name, f):
        began = time.perf_counter()
        value = f()
        took[name] = round(time.perf_counter() - began, 3)
        return value

    def model() -> CountModel:
        saved = cfg.model_path or (model_file if os.path.isfile(model_file) and only and not args.train_only else None)
        if saved:
            with open(saved, "rb") as f:
                return CountModel.from_bytes(f.read())
        source = rows if path == cfg.file_path else ranges.chunks_of(spark, cfg.file_path, cfg.seq_size)
        made = train_counts(source, cfg.order)
        with open(model_file, "wb") as f:
            f.write(made.to_bytes())
        return made

    if args.comparison_baseline_only:
        out["baselines"] = [r.asDict() for r in timed("baselines", lambda: baselines.baseline_sizes(rows).collect())]
    else:
        m = timed("train", model)
        if not only or args.compress_only:
            timed("compress", lambda: container.save(codec.compress(container.ranged(rows, spark.sparkContext.defaultParallelism), m), folder, cfg.seq_size, m.fingerprint, mode="overwrite"))
            size = sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder))
            original = sum(r["uncompressed_len"] for r in container.metadata(spark, folder).collect())
            out |= {"original": original, "compressed": size, "ratio": original / size if size else float("inf")}
        if not only or args.decompress_only:
            back = codec.decompress(container.load(spark, folder, fingerprint=m.fingerprint.hex()), m)

            def write():
                with open(decoded, "wb") as f:
                    for r in back.orderBy("chunk_id").toLocalIterator():  # a chunk at a time, in order
                        f.write(r["data"])

            timed("decompress", write)
        if args.verify:
            again = ranges.chunks_of(spark, decoded, cfg.seq_size).select("chunk_id", "data")
            bad = timed("verify", lambda: compare.verify_bytes(rows, again, "chunk_id").where("status <> 'ok'").orderBy("chunk_id").first())
            out["verified"] = bad is None
            if bad is not None:
                out["first_difference"] = {k: bad[k] for k in ("chunk_id", "status", "first_diff")}
        if args.evaluate or args.evaluate_only:
            last = rows.agg(F.max("chunk_id")).first()[0] + 1
            cut = rows.withColumn("split", splits.cut_of(F.col("chunk_id"), F.lit(last)))
            pairs = spark.createDataFrame(counts.pair_counts(cut, keys=("split",)).toArrow())
            seen = metrics.outcomes(pairs, metrics.model_table(pairs.where("split = 'train'").select("ctx", "byte", "n")))
            curve = metrics.calibration(seen, metrics.uniform_edges(20))
            out["bits_per_byte"] = {r["split"]: r["bpb"] for r in timed("evaluate", lambda: metrics.bits_per_byte(seen, ["split"]).collect())}
            out["calibration_error"] = {r["split"]: r["ece"] for r in metrics.expected_error(curve).collect()}
            out["top_k"] = {r["k"]: r["accuracy"] for r in metrics.top_k(seen, 20).collect()}
    if args.show_timings:
        out["seconds"] = took
    return out


if __name__ == "__main__":
    print(json.dumps(main(), indent=1, default=str))

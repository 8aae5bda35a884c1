"""Mixing of sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the corpus's size; a target stops at REPEATS
times its source's size, and the excess is shared by weight among the rest until none is above (water filling).

Quotas: the corpus is worth so many blocks of BLOCK words (of fewer in a corpus of under LEAST_BLOCKS such blocks, so that shares stay
fine); each goes to the source with the highest quotient target / (2 seats + 1).
A source's seats are dealt to its shards in the same way, by the shards' sizes; shards hold about SHARD words, so that a source of
any size is many shards and no window grows with it. A shard's quota of words is taken in whole passes over the shard, and the
rest from its blocks in a seeded order: the documents stand in the order of a seeded hash, and the first blocks are taken.

Only a row for each source, of which there must be at most MAX_SOURCES, reaches the driver; shards are apportioned where they are.

Defined results: null text has size 0; empty texts and tables take nothing; rows that repeat a doc_id and a text are separate rows and
ties among them take equal turns; other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS, REPEATS = (5, 2, 1), 3
BLOCK, LEAST_BLOCKS, SHARD, SEED = 64, 4096, 1 << 20, 17
MAX_SOURCES = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, repeats: int = REPEATS) -> list[float]:
    """Shares of total by weight, none above repeats times its size, the excess reshared by weight."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    rest = float(total)
    while open_:
        level = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * level
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 seats + 1), ties to the first; begun near the end of that sequence, so that the cost
    follows the number of parties."""
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    # With a divisor a little too large every party has at most its final seats; the rest are dealt one by one.
    divisor = total / max(seats - len(votes) / 2 - 1, 0.5)
    got = [int(v / divisor + 0.5) for v in votes]
    while sum(got) > seats:
        divisor *= 1.0 + (sum(got) - seats) / seats
        got = [int(v / divisor + 0.5) for v in votes]
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _deal():
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        quota = sainte_lague(rows["shard_size"].tolist(), int(rows["seats"].iloc[0]))
        return pd.DataFrame({"source_key": rows["source_key"], "shard": rows["shard"], "shard_size": rows["shard_size"], "quota": [q * int(b) for q, b in zip(quota, rows["block_words"])]})

    return deal


def plan(sized: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """(source_null, source_key, source_size, target, seats, shards, block_words) of each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: name coarser ones")
    per = sorted(((r.source, r.n or 0) for r in per), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))
    sizes = [n for _, n in per]
    goal = targets(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(per))], sum(sizes), repeats)
    block = max(1, min(block, sum(sizes) // LEAST_BLOCKS))
    seats = sainte_lague(goal, sum(sizes) // block)  # targets add up to all sizes
    rows = [(s is None, s or "", n, t, k, max(1, -(-n // SHARD)), block) for (s, n), t, k in zip(per, goal, seats)]
    return sized.sparkSession.createDataFrame(rows, "source_null boolean, source_key string, source_size long, target double, seats long, shards long, block_words long")


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, repeats: int = REPEATS, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of the row, repeats counted) for each row; with ``carry``, all
    other columns of ``docs`` as well."""
    own = ["doc_id", "size", "source_size", "target", "taken"]
    others = [c for c in docs.columns if c not in own] if carry else []
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5("text")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # Texts are counted once, and once more only where whole rows are carried: a table of a few numbers a row serves the rest.
    sized = materialise(docs.select("doc_id", "source", size.alias("size"), turn.alias("turn")), "sized")
    whole = docs.select("doc_id", "source", size.alias("size"), turn.alias("turn"), F.struct(*others).alias("row_")) if others else sized
    keyed = lambda rows: rows.withColumns({"source_null": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit(""))}).drop("source")
    # at most MAX_SOURCES rows of a name and five numbers
    planned = F.broadcast(plan(sized, block, repeats))

    def place(rows: DataFrame) -> DataFrame:
        placed = keyed(rows).join(planned, ["source_null", "source_key"])
        return placed.withColumn("source_key", F.concat(F.col("source_null").cast("string"), F.col("source_key"))).withColumn("shard", F.pmod(F.xxhash64("turn"), "shards"))

    shards = place(sized).groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"), F.first("block_words").alias("block_words"))
    quotas = shards.groupBy("source_key").applyInPandas(_deal(), "source_key string, shard long, shard_size long, quota long")
    turns = Window.partitionBy("source_key", "shard").orderBy("turn", "size", *(F.xxhash64("row_"),) * bool(others)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = place(whole).join(quotas.hint("merge"), ["source_key", "shard"]).withColumn("before", F.sum("size").over(turns) - F.col("size"))
    quota = F.least(F.col("quota"), F.col("shard_size") * repeats)
    passes = F.when(F.col("shard_size") > 0, F.floor(quota / F.col("shard_size"))).otherwise(0).cast("long")
    rest = quota - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return dealt.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(F.col(f"row_.`{c}`") for c in others))

"""Chunk compression of streams: whole chunks leave as they fill, a partial chunk for each source waits in state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans.codec import compress

STATE = "pending binary, chunk long"
CHUNK = "src_id string, chunk_id long, data binary"


def chunk_stream(stream: DataFrame, chunk_len: int, key: str = "src_id", order: str = "seq", data: str = "data", end: str | None = None, idle: int | None = None) -> DataFrame:
    """(src_id, chunk_id, data): whole chunks as they fill. Within a micro-batch a source's values join in ``order``; what does not fill a
    chunk waits: one partial chunk for each source, whatever has passed. It leaves, as a shorter chunk, with the row whose column
    ``end`` is true, or when the source has been silent for ``idle`` milliseconds; with neither it waits for ever. What a source sends
    after that begins a new chunk."""

    def fill(name, frames, state):
        pending, chunk = state.get if state.exists else (b"", 0)
        last = state.hasTimedOut
        parts = [bytes(pending)]
        if not last:
            rows = pd.concat(list(frames)).sort_values(order, kind="stable")
            parts += [bytes(v) for v in rows[data] if v is not None]
            last = bool(end and rows[end].fillna(False).any())
        whole = b"".join(parts)
        cuts = range(0, len(whole) if last else len(whole) // chunk_len * chunk_len, chunk_len)
        out = [(str(name[0]), chunk + i, whole[at : at + chunk_len]) for i, at in enumerate(cuts)]
        state.update((b"" if last else whole[len(whole) // chunk_len * chunk_len :], chunk + len(out)))
        if idle and not last:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["src_id", "chunk_id", "data"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.select(key, order, data, *([end] if end else [])).groupBy(key).applyInPandasWithState(fill, CHUNK, STATE, "append", timeout)


def compress_stream(stream: DataFrame, model, path: str, checkpoint: str, chunk_len: int, once: bool = True, end: str | None = None, idle: int | None = None):
    """Starts a query that writes compressed chunks as Parquet, exactly once."""
    chunks = chunk_stream(stream, chunk_len, end=end, idle=idle)
    out = compress(chunks, model).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def compress_batches(stream: DataFrame, model, sink, checkpoint: str, once: bool = True):
    """The same for streams of chunk rows: each micro-batch is compressed and handed to ``sink(frame, batch_id)``."""
    out = stream.writeStream.foreachBatch(lambda df, i: sink(compress(df, model), i)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()

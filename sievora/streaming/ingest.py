"""Streaming ingest: documents of a stream become part of an index as they arrive, and are searchable at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sievora.operators.ranking import RankedIndex


def stream_insert(index: RankedIndex, stream: DataFrame, checkpoint: str, at: str | None = None, delay: str = "1 hour", maintain_every: int = 0, **trigger: object) -> StreamingQuery:
    """Insert the rows of a stream into an index that has a path; returns the running query.

    Each batch is one part of the growing documents, named by the stream's checkpoint and the batch, so a batch that
    is replayed after a failure replaces itself. With `at`, an event time column, rows that repeat an id within
    `delay` are dropped. maintain_every > 0 seals the index after every so many batches. trigger goes to
    the writer (availableNow=True by default).
    """
    if not index.path:
        raise ValueError("streaming needs an index with a path")
    if at:
        stream = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([index.source["id"]])
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def add(batch: DataFrame, number: int) -> None:
        index.insert(batch, key=f"{name}-{number}")
        if maintain_every and (number + 1) % maintain_every == 0:
            index.maintain()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

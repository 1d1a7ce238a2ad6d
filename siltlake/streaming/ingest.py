"""Streams of writes into a store: a micro-batch is a flush."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Write (key, value, seq) of a stream.  The manifest keeps the number of each batch
    it holds, so a batch that is run again changes nothing."""

    def batch(df: DataFrame, n: int) -> None:
        store.put_all(df, batch=f"{name}-{n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

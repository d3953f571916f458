"""Streaming ingest: batches into a store, and newest versions as a streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake import schema as S
from ledgerlake.plans.store import Store


def latest_stream(log: DataFrame) -> DataFrame:
    """Newest version per key of a streaming changelog. Order is the sequence number, so what arrives late loses."""
    return log.groupBy("user_key").agg(F.max_by(F.struct("kind", "value", "seqno"), "seqno").alias("w")).select("user_key", "w.kind", "w.value", "w.seqno")


def live(stream_state: DataFrame) -> DataFrame:
    return stream_state.where(F.col("kind") == S.PUT).drop("kind")


def ingest_stream(batches: DataFrame, store: Store, checkpoint: str, flush_every: int = 1) -> StreamingQuery:
    """Append each micro-batch of ``batch_id, ops`` and flush every so many.

    A micro-batch that is repeated is skipped, wherever it was stopped: its number is in the name of
    the log segment that holds it, and stays marked when that segment goes into a run.
    """
    def append(frame: DataFrame, number: int) -> None:
        store.ingest(frame, micro_batch=number)
        if (number + 1) % flush_every == 0:
            store.flush()

    return batches.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Streams: idempotent ingestion into a store, and a feedback ledger with keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom.sources.store import Store


def into_store(stream: DataFrame, store: Store, name: str, checkpoint: str, namespace: str = "default"):
    """Starts a query that ingests each micro-batch of items; items at positions the cursor has passed are replays."""

    def batch(df: DataFrame, _: int) -> None:
        cursor = store.cursor(name, namespace)
        fresh = df.where(F.col("pos") >= cursor)
        if not fresh.isEmpty():
            store.ingest(fresh, name, cursor, namespace)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_operations(stream: DataFrame, delay: str) -> DataFrame:
    """The stream without repeats of an operation id within the watermark's delay (column at)."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["namespace", "operation_id"])


def activity(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Feedback counts per outcome and window of event time."""
    return stream.withWatermark("at", delay).groupBy(F.window("at", width), "outcome").count()

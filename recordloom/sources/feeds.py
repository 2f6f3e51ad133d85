"""What a host implements to feed a store, and plain ingestion."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from recordloom.errors import ConflictError
from recordloom.operators import ledger
from recordloom.sources.store import Store


class Source(Protocol):
    """Gives records with their place in the source (column pos)."""

    def records(self) -> DataFrame: ...


class CheckpointSource(Protocol):
    """Gives items (pos, operation_id, fingerprint and a record's fields) from a cursor on."""

    def records_from(self, cursor: int) -> DataFrame: ...


def ingest(store: Store, source: Source) -> int:
    """Puts the source's records in order and stops at the first conflict: what stands before it is kept.

    A record conflicts if its revision isn't the stored one (0 for a new id), or if its id came before.
    """
    rows = source.records()
    stored = ledger.latest(store.all_history()).select("namespace", "id", F.col("revision").alias("stored"))
    firsts = rows.groupBy("namespace", "id").agg(F.min("pos").alias("first"))
    judged = rows.join(firsts, ["namespace", "id"]).join(stored, ["namespace", "id"], "left")
    bad = (F.col("pos") != F.col("first")) | (F.col("revision") != F.coalesce("stored", F.lit(0)))
    cut = judged.where(bad).agg(F.min("pos")).first()[0]
    good = rows if cut is None else rows.where(F.col("pos") < cut)
    n = good.count()
    if n:
        store.put(good)
    if cut is not None:
        raise ConflictError("a record's revision is not the stored one")
    return n


def drain(store: Store, source: CheckpointSource, name: str, namespace: str = "default") -> DataFrame:
    """One checkpointed step: the items from the store's cursor on."""
    cursor = store.cursor(name, namespace)
    return store.ingest(source.records_from(cursor), name, cursor, namespace)

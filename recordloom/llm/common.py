"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strings(column: pd.Series) -> list[str]:
    """Texts of a batch; null counts as empty."""
    return ["" if x is None or x is pd.NA or x != x else x for x in column]


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir, the folder every machine sees.

    Where the setting is absent a local session (tests) uses a folder in the warehouse; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/recordloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_owner(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of integer weights, for each of n owners."""
    return np.bincount(owner, weights, n).astype(np.int64)


def release() -> None:
    """Gives memory that earlier work of a reused Python worker freed back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    from . import words

    words.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1_000):
    """Holds Arrow batches to so many rows within a block: they carry whole texts, and a worker holds a batch or two.

    The plans of the block must be run (written) within it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    if int(before) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A key is hot if it has more than 1 in HOT of all rows, so that there are fewer than HOT of them; it is dealt over SALTS tasks.
HOT, SALTS = 1_000, 256


def join_dealt(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row a key at most; the rows of hot keys of left are dealt over many tasks.

    Fewer than HOT keys are broadcast, whatever the size of the tables.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = materialise(counts.where(F.col("__n") > total / HOT).where(F.col("__n") > HOT).select(key, F.lit(SALTS).alias("__salts")))
    salt = F.pmod(F.monotonically_increasing_id(), F.coalesce("__salts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__salts")
    copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    right = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(copies)).drop("__salts")
    return dealt.join(right, [key, "__salt"], how).drop("__salt")

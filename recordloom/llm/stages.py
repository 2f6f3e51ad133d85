"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame.

One set of executors and Python workers runs all stages and keeps the most memory that any of them took. So each
stage runs its Python code before it returns, with Arrow batches of bounded size, and writes what that code gives.
"""

from __future__ import annotations

from . import decontam, neardup, packing, pii, quality_rules
from .common import bounded_batches, materialise


def quality(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    with bounded_batches(spark):
        return materialise(quality_rules.keep_good(docs))


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near duplicates."""
    return neardup.keep_one(docs).select(*docs.columns)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    with bounded_batches(spark):
        return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def redact(spark, docs, sf_dir):
    """All documents, with personal data masked."""
    with bounded_batches(spark):
        return materialise(pii.redact(docs))


def pack(spark, docs, sf_dir):
    """Pieces of packed sequences."""
    import public_tokenizers

    with bounded_batches(spark):
        return materialise(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))

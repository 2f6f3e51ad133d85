"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from recordloom.llm import stages
from recordloom.llm.common import shared_dir

STAGES = [
    ("quality_rules", stages.quality),
    ("minhash_near_dedup", stages.near_dedup),
    ("benchmark_decontamination", stages.decontaminate),
    ("pii", stages.redact),
    ("packing", stages.pack),
]

#: The stages rest on models and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages over documents; every stage's result goes through a written table."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        stage(spark, df, sf_dir).write.parquet(path)
        df = spark.read.parquet(path)
    return STAGES[-1][1](spark, df, sf_dir)

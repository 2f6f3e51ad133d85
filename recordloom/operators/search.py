"""A rebuildable text index with BM25: one row of tokens a record, and a stored form by namespace."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recordloom.errors import whole
from recordloom.functions import text as tx
from recordloom.session import cut_lineage

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Latin letters with marks and their plain forms, for folding without Python.
_MARKED = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1)
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def fold(text):
    return F.translate(F.lower(F.translate(text, _MARKED, _PLAIN)), _MARKED, _PLAIN)


def _fold_here(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))


def index(records: DataFrame) -> DataFrame:
    """namespace, id, revision, length and body (tokens between spaces) of active records with text."""
    kept = records.where((F.col("status") == "active") & (F.trim("text") != ""))
    tokens = F.regexp_extract_all(fold(F.col("text")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = kept.select("namespace", "id", "revision", tokens.alias("tokens"))
    # two spaces between tokens, so that neighbours don't share one when phrases are counted
    return rows.select("namespace", "id", "revision", F.size("tokens").alias("length"), F.concat(F.lit(" "), F.array_join("tokens", "  "), F.lit(" ")).alias("body")).where("length > 0")


class StoredIndex:
    """An index kept as a table by namespace; a rebuild replaces its namespace and leaves the others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rebuild(self, records: DataFrame, namespace: str) -> dict:
        """Indexes the namespace's records. Returns a receipt: namespace and how many records it has now."""
        rows = cut_lineage(index(records.where(F.col("namespace") == namespace)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(self.path)
        return {"namespace": namespace, "indexed": rows.count()}

    def read(self) -> DataFrame:
        return self.spark.read.schema("id string, revision bigint, length int, body string, namespace string").parquet(self.path)


def _count(phrase: list[str]) -> Column:
    """How often the body has the tokens one after another, overlaps included."""
    wanted = " " + "  ".join(phrase) + " "
    if len(phrase) == 1 or len(set(phrase)) == len(phrase):  # can't overlap itself
        return ((F.length("body") - F.length(F.replace("body", F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")
    return F.size(F.regexp_extract_all("body", F.lit(f"{re.escape(wanted[: len(phrase[0]) + 2])}(?={re.escape(wanted[len(phrase[0]) + 2 :])})"), F.lit(0)))


def candidates(indexed: DataFrame, query: str, limit: int = 100, namespace: str | None = None) -> DataFrame:
    """id, revision, bm25 (the better, the lower) and position of the best matches of any term.

    Scores are rounded to 12 places, so that equal ones tie. Statistics cover all indexed namespaces. A term of
    several tokens matches as a phrase. The index is read once: lengths and counts are written as a narrow table.
    """
    whole(limit, "limit", 0, 10_000)
    wanted = [re.findall(r"[^\W_]+", _fold_here(t)) for t in tx.terms(query[: tx.MAX_QUERY_CHARS])[: tx.MAX_TERMS]]
    wanted = [w for w in wanted if w]
    if not wanted:
        return indexed.where("false").select("id", "revision", F.lit(0.0).alias("bm25"), F.lit(1).alias("position"))
    counted = cut_lineage(indexed.select("namespace", "id", "revision", "length", *(_count(w).alias(f"tf{i}") for i, w in enumerate(wanted))))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score = score + F.when(idf <= 0, LEAST_IDF).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hit = F.greatest(F.lit(0), *(F.col(f"tf{i}") for i in range(len(wanted)))) > 0
    scored = counted.where(hit).crossJoin(F.broadcast(stats)).select("namespace", "id", "revision", F.round(-score, 12).alias("bm25"))  # stats is one row
    if namespace is not None:
        scored = scored.where(F.col("namespace") == namespace)
    best = scored.orderBy("bm25", "id").limit(limit)
    return best.select("id", "revision", "bm25", F.row_number().over(Window.orderBy("bm25", "id")).alias("position"))

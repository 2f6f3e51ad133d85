"""Recall: evidence, lexical rank, index fusion, graph expansion, top-k and excerpts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from recordloom.errors import finite, whole
from recordloom.functions import text as tx
from recordloom.operators import excerpt, graph, provenance, search
from recordloom.session import cut_lineage


def eligible(records: DataFrame, principal: str, now: float, evidence: DataFrame | None = None) -> DataFrame:
    """Records with their evidence and the reason for which they are left out (null: eligible)."""
    if not principal or principal == "*":
        raise ValueError("principal must identify a concrete audience")
    finite(now, "now")
    evidence = provenance.resolve(records, now) if evidence is None else evidence
    e = evidence.select("id", F.col("complete").alias("sound"), F.col("trust").alias("resolved_trust"), F.col("audience").alias("resolved_audience"), "witnesses")
    reason = F.when(~F.col("sound"), "provenance").when(~provenance.allowed(F.col("resolved_audience"), principal), "access")
    return records.join(e, "id").withColumn("reason", reason)


def own_evidence(records: DataFrame, now: float) -> DataFrame:
    """Evidence of records without sources: no join is needed."""
    sound = F.size("issues") == 0
    return provenance.nodes_and_refs(records, now)[0].select(
        "id", sound.alias("complete"), F.when(F.col("trust") == 0, "untrusted").when(~sound | (F.col("trust") == 1), "unknown").otherwise("trusted").alias("trust"),
        F.when(sound, F.col("audience")).otherwise(F.array().cast("array<string>")).alias("audience"), F.array_sort("issues").alias("issues"),
        F.when(F.col("witness"), F.array("id")).otherwise(F.array().cast("array<string>")).alias("witnesses"),
    )


def counts(judged: DataFrame) -> DataFrame:
    """Scanned, eligible, and left out by reason."""
    return judged.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("reason").isNull()).alias("eligible"), F.count_if(F.col("reason") == "provenance").alias("provenance"), F.count_if(F.col("reason") == "access").alias("access"))


def lexical(judged: DataFrame, query: str, now: float) -> DataFrame:
    """Eligible records that meet enough of the query's conditions, with overlap and score."""
    n = len(tx.conditions(query))
    kept = judged.where(F.col("reason").isNull())
    if not n:
        return kept.where("false").withColumns({"overlap": F.lit(0), "score": F.lit(0.0)})
    met = kept.withColumn("overlap", tx.overlap(F.col("text"), query)).where(F.col("overlap") >= tx.required(n))
    return met.withColumn("score", tx.rank(F.col("overlap"), F.col("confidence"), F.col("created_at"), F.col("kind"), now))


def recall(records: DataFrame, query: str, principal: str, now: float, edges: DataFrame | None = None, index: DataFrame | None = None, limit: int = 10, depth: int = 2, fanout: int = 25, max_nodes: int = 256, excerpt_chars: int = 1200, evidence: DataFrame | None = None, namespace: str | None = None) -> DataFrame:
    """The best `limit` records of one namespace with score, routes, resolved trust, witnesses and excerpt.

    Without `namespace` the records must be of one; index and edges may hold others.
    """
    whole(limit, "limit")
    whole(depth, "graph_depth", 0, 8)
    whole(fanout, "graph_fanout", 1)
    whole(max_nodes, "graph_max_nodes", 1)
    whole(excerpt_chars, "excerpt_chars", 1)
    if namespace is None and (index is not None or edges is not None):
        namespace = records.agg(F.max("namespace")).first()[0]
    if namespace is not None:
        records = records.where(F.col("namespace") == namespace)
        edges = edges.where(F.col("namespace") == namespace) if edges is not None and "namespace" in edges.columns else edges
    judged = eligible(records, principal, now, evidence)
    fit = judged.where(F.col("reason").isNull())
    scores = lexical(judged, query, now).select("id", "score", F.lit("lexical").alias("route"))
    if index is not None:
        best = search.candidates(index, query, namespace=namespace).join(fit.select("id", "revision"), ["id", "revision"], "left_semi")
        scores = scores.unionByName(best.select("id", (1 / (60 + F.col("position"))).alias("score"), F.lit("fts5").alias("route")))
    scores = scores.groupBy("id").agg(F.sum("score").alias("score"), F.collect_set("route").alias("routes"))
    if edges is not None and depth:
        scores = cut_lineage(scores)
        if not scores.isEmpty():
            reached = graph.expand(graph.usable(edges, fit), scores, depth, fanout, max_nodes)
            both = scores.join(reached, "id", "full")
            scores = both.select("id", F.greatest("score", "graph").alias("score"), F.when(F.col("graph").isNull(), F.col("routes")).otherwise(F.array_union(F.coalesce("routes", F.array().cast("array<string>")), F.array(F.lit("graph")))).alias("routes"))
    top = scores.orderBy(F.desc("score"), "id").limit(limit)
    carried = [c for c in records.columns if c != "id"]
    hits = fit.select("id", *carried, "resolved_trust", "witnesses").join(F.broadcast(top), "id")

    @F.pandas_udf(T.StringType())
    def passage(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: excerpt.excerpt(t, query, excerpt_chars))

    return hits.withColumns({"routes": F.array_sort("routes"), "excerpt": passage("text")}).orderBy(F.desc("score"), "id")

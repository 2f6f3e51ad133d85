"""Bounded expansion over a graph of concepts whose edges are backed by records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recordloom.functions import text as tx
from recordloom.session import cut_lineage

DECAY = 0.6


def usable(edges: DataFrame, eligible: DataFrame) -> DataFrame:
    """Edges whose backing record is eligible at the edge's revision."""
    return edges.join(eligible.select(F.col("id").alias("record_id"), "revision"), ["record_id", "revision"], "left_semi")


def last_written(edges: DataFrame, order: str) -> DataFrame:
    """The last write of each edge. Endpoints are folded to one case; relations keep theirs."""
    key = ["namespace", "source", "relation", "target", "record_id"]
    folded = edges.withColumns({"source": tx.casefold(F.col("source")), "target": tx.casefold(F.col("target"))})
    return folded.groupBy(*key).agg(F.max_by(F.struct("revision", "weight"), F.col(order)).alias("x")).select(*key, "x.revision", "x.weight")


def ranked(edges: DataFrame, fanout: int) -> DataFrame:
    """Both directions of the edges, the best `fanout` of each node with their rank."""
    there = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "record_id", "weight")
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "record_id", "weight")
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "other", "record_id")
    return there.unionByName(back).withColumn("edge_rank", F.row_number().over(order)).where(F.col("edge_rank") <= fanout)


def seeds(edges: DataFrame, scored: DataFrame, max_nodes: int) -> DataFrame:
    """Endpoints of edges backed by scored records, the first max_nodes by name."""
    own = edges.join(scored.select(F.col("id").alias("record_id")), "record_id", "left_semi")
    return own.select(F.explode(F.array("source", "target")).alias("node")).distinct().orderBy("node").limit(max_nodes)


def expand(edges: DataFrame, scored: DataFrame, depth: int = 2, fanout: int = 25, max_nodes: int = 256) -> DataFrame:
    """id and graph score of the records behind the edges reached, level by level.

    A node's weight is that of the first path to it, in queue order; there are at most max_nodes
    nodes, so that the windows over a level are small.
    """
    near = cut_lineage(ranked(edges, fanout))
    front = seeds(edges, scored, max_nodes).select("node", F.row_number().over(Window.orderBy("node")).alias("place"), F.lit(1.0).alias("path"))
    front = cut_lineage(front)
    visited, found = front.select("node"), None
    for level in range(depth):
        step = cut_lineage(front.join(near, "node"))
        score = step.select(F.col("record_id").alias("id"), (F.col("path") * F.col("weight") * DECAY**level).alias("graph"))
        found = score if found is None else found.unionByName(score)
        left = max_nodes - visited.count()
        new = step.join(visited.select(F.col("node").alias("other")), "other", "left_anti").groupBy("other").agg(F.min(F.struct("place", "edge_rank", (F.col("path") * F.col("weight")).alias("path"))).alias("x"))
        order = Window.orderBy("x.place", "x.edge_rank")
        new = new.orderBy("x.place", "x.edge_rank").limit(max(0, left))  # a top-k before the one window
        front = new.select(F.col("other").alias("node"), F.row_number().over(order).alias("place"), F.col("x.path").alias("path"))
        front = cut_lineage(front)
        visited = cut_lineage(visited.unionByName(front.select("node")))
    return found.groupBy("id").agg(F.max("graph").alias("graph"))

"""Records, references and edges made from the driver's tables by fixed rules (no wall clock)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.functions import identity, text as tx

EPOCH = 1704067200
NOW = float(EPOCH + 40 * 86400)
PRINCIPAL = "worker"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document; audience, status, completeness and expiry follow from doc_id, trust from its labels."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source").join(labels, "doc_id", "left")
    n, day = F.col("doc_id"), 86400
    return d.select(
        F.lit("documents").alias("namespace"),
        identity.record_id(F.lit("documents"), F.col("source"), n.cast("string"), F.col("text")).alias("id"),
        F.lit(1).cast("bigint").alias("revision"),
        "text",
        "source",
        F.lit(None).cast("string").alias("author"),
        tx.classify_kind(F.col("text")).alias("kind"),
        F.when(F.col("toxic") == 1, "untrusted").when(F.col("quality") == 1, "trusted").otherwise("unknown").alias("trust"),
        F.when(n % 7 == 0, F.array().cast("array<string>")).when(n % 7 == 1, F.array(F.lit("worker"))).when(n % 7 == 2, F.array(F.lit("other"))).otherwise(F.array(F.lit("*"))).alias("audience"),
        F.array().cast("array<struct<id:string,revision:bigint>>").alias("sources"),
        F.lit(False).alias("derived"),
        (n % 13 != 6).alias("complete"),
        ((n % 5 + 6) / 10.0).alias("confidence"),
        (F.lit(float(EPOCH)) + 3600 * n).alias("created_at"),
        F.lit(None).cast("double").alias("occurred_at"),
        F.when(n % 17 == 3, F.lit(float(EPOCH)) + 3600 * n + day).alias("expires_at"),
        F.when(n % 11 == 5, "retired").otherwise("active").alias("status"),
        "doc_id",
    )


def shipments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A provenance graph with diamonds: shipment to order to customer to nation to region, and to supplier to nation.

    Returns nodes (id, trust, audience, inactive, incomplete) and references (child, parent).
    """
    key = lambda prefix, *cols: F.concat_ws(":", F.lit(prefix), *(F.col(c).cast("string") for c in cols))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    levels = [
        (li, key("ship", "l_orderkey", "l_suppkey"), [key("order", "l_orderkey"), key("supp", "l_suppkey")]),
        (o, key("order", "o_orderkey"), [key("cust", "o_custkey")]),
        (c, key("cust", "c_custkey"), [key("nation", "c_nationkey")]),
        (s, key("supp", "s_suppkey"), [key("nation", "s_nationkey")]),
        (n, key("nation", "n_nationkey"), [key("region", "n_regionkey")]),
        (r, key("region", "r_regionkey"), []),
    ]
    nodes = refs = None
    for df, own, parents in levels:
        number = F.element_at(F.split(own, ":"), 2).cast("bigint")
        kind = F.element_at(F.split(own, ":"), 1)
        node = df.select(
            own.alias("id"),
            F.when((kind == "cust") & (number % 10 == 3), 0).when((kind == "supp") & (number % 4 == 1), 1).otherwise(2).alias("trust"),
            F.when((kind == "order") & (number % 5 == 2), F.array(F.lit("worker"), F.lit("boss"))).when((kind == "supp") & (number % 9 == 4), F.array(F.lit("boss"))).otherwise(F.array(F.lit("*"))).alias("audience"),
            ((kind == "order") & (number % 23 == 7)).alias("inactive"),
            ((kind == "cust") & (number % 29 == 11)).alias("incomplete"),
        )
        nodes = node if nodes is None else nodes.unionByName(node)
        for parent in parents:
            ref = df.select(own.alias("child"), parent.alias("parent"))
            refs = ref if refs is None else refs.unionByName(ref)
    return nodes, refs


def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected weighted edges backed by records: customer to nation, supplier to nation, nation to region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nation = F.lower("n_name")
    cust = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("c_name").alias("source"), F.lit("lives_in").alias("relation"), nation.alias("target"), F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("record_id"), ((F.col("c_custkey") % 9 + 1) / 10.0).alias("weight"))
    supp = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("s_name").alias("source"), F.lit("ships_from").alias("relation"), nation.alias("target"), F.concat(F.lit("supp:"), F.col("s_suppkey").cast("string")).alias("record_id"), ((F.col("s_suppkey") % 7 + 3) / 10.0).alias("weight"))
    nat = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(nation.alias("source"), F.lit("part_of").alias("relation"), F.lower("r_name").alias("target"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("record_id"), F.lit(1.0).alias("weight"))
    return cust.unionByName(supp).unionByName(nat).withColumn("revision", F.lit(1).cast("bigint"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history: each event is the next revision of its user's record. A user's history is dealt out by user."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    order = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(F.lit("events").alias("namespace"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.row_number().over(order).cast("bigint").alias("revision"), F.col("event_type").alias("text"), "event_id")

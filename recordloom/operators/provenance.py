"""Provenance closure as a bottom-up pass over a graph of exact parent revisions.

Properties of a record's closure (complete, trust, audience, height) are meets
over the record and its parents, so that one join per level replaces a walk per
root. Records that never get finished reach a cycle. Upper bounds on the number
of nodes come along; only roots above the budget are counted exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from recordloom.errors import whole
from recordloom.session import cut_lineage

MAX_NODES, MAX_DEPTH = 4096, 32
_STAR = "*"


def meet(audiences):
    """Intersection of audience lists; '*' is neutral, no list but '*' gives '*'."""
    named = F.filter(audiences, lambda a: ~F.array_contains(a, _STAR))
    inner = F.aggregate(F.slice(named, 2, F.greatest(F.size(named), F.lit(1))), F.element_at(named, 1), F.array_intersect)
    return F.when(F.size(named) == 0, F.array(F.lit(_STAR))).otherwise(F.array_sort(inner))


def nodes_and_refs(records: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Local issues of each current record, and its references with what is wrong with each."""
    inactive = (F.col("status") != "active") | F.coalesce(F.lit(now) >= F.col("expires_at"), F.lit(False))
    local = F.filter(
        F.array(
            F.when(inactive, "inactive"), F.when(~F.col("complete"), "incomplete"), F.when(F.col("derived") & (F.size("sources") == 0), "missing_provenance")
        ),
        lambda x: x.isNotNull(),
    )
    trust = F.when(F.col("trust") == "untrusted", 0).when(F.col("trust") == "unknown", 1).otherwise(2)
    nodes = records.select("namespace", "id", "revision", trust.alias("trust"), "audience", local.alias("issues"), (~F.col("derived") & (F.size("sources") == 0)).alias("witness"))
    refs = records.select("namespace", F.col("id").alias("child"), F.posexplode("sources").alias("pos", "s")).select("namespace", "child", "pos", F.col("s.id").alias("parent"), F.col("s.revision").alias("parent_revision"))
    stored = records.select("namespace", F.col("id").alias("parent"), F.col("revision").alias("stored"))
    refs = refs.join(stored, ["namespace", "parent"], "left")
    issue = F.when(F.col("stored").isNull(), "missing_source").when(F.col("stored") != F.col("parent_revision"), "changed_source")
    return nodes, refs.select("namespace", "child", "parent", issue.alias("issue"))


def propagate(nodes: DataFrame, refs: DataFrame, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id, complete, trust (0 untrusted to 2), audience, issues, witnesses and height of every node.

    nodes: id, trust, audience, issues, witness. refs: child, parent, issue (null if sound); a
    missing parent is not followed.
    """
    whole(max_nodes, "max_nodes", 1)
    whole(max_depth, "max_depth")
    refs = cut_lineage(refs)
    follow = cut_lineage(refs.where(F.coalesce(F.col("issue") != "missing_source", F.lit(True))).select("child", "parent").distinct())
    waits = follow.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("parents"))
    wrong = refs.where(F.col("issue").isNotNull()).groupBy(F.col("child").alias("id")).agg(F.collect_set("issue").alias("ref_issues"))
    none = F.array().cast("array<string>")
    start = nodes.join(waits, "id", "left").join(wrong, "id", "left").select(
        "id", "trust", "audience", F.array_union("issues", F.coalesce("ref_issues", none)).alias("issues"),
        F.when(F.col("witness"), F.array("id")).otherwise(none).alias("witnesses"), F.coalesce("parents", F.lit(0)).alias("parents"),
    )
    start = cut_lineage(start)
    new = cut_lineage(start.where("parents = 0").withColumns({"height": F.lit(0), "bound": F.lit(1).cast("bigint")}).drop("parents"))
    levels, waiting = [new], None
    while not new.isEmpty():
        # a finished level is handed to its children once; what a child has got so far waits for its other parents
        given = follow.join(new.withColumnRenamed("id", "parent"), "parent").select(
            "child", F.lit(1).cast("bigint").alias("found"), F.col("trust").alias("p_trust"), F.array("audience").alias("p_audiences"), F.col("issues").alias("p_issues"),
            F.col("witnesses").alias("p_witnesses"), "height", "bound",
        )
        got = (given if waiting is None else given.unionByName(waiting)).groupBy("child").agg(
            F.sum("found").alias("found"), F.min("p_trust").alias("p_trust"), F.array_distinct(F.flatten(F.collect_set("p_audiences"))).alias("p_audiences"),
            F.array_distinct(F.flatten(F.collect_set("p_issues"))).alias("p_issues"), F.slice(F.array_distinct(F.flatten(F.collect_set("p_witnesses"))), 1, max_nodes + 1).alias("p_witnesses"),
            F.max("height").alias("height"), F.sum("bound").alias("bound"),
        )
        got = cut_lineage(got.join(start.select(F.col("id").alias("child"), "parents"), "child"))
        waiting, full = got.where("found < parents").drop("parents"), got.where("found = parents").drop("parents")
        new = cut_lineage(start.drop("parents").join(full.withColumnRenamed("child", "id"), "id").select(
            "id", F.least("trust", "p_trust").alias("trust"), meet(F.concat(F.array("audience"), F.col("p_audiences"))).alias("audience"),
            F.array_union("issues", "p_issues").alias("issues"), F.slice(F.array_union("witnesses", "p_witnesses"), 1, max_nodes + 1).alias("witnesses"),
            (F.col("height") + 1).alias("height"), (F.col("bound") + 1).alias("bound"),
        ))
        levels.append(new)
    finished = reduce(DataFrame.unionByName, (x.select("id") for x in levels))
    todo = start.where("parents > 0").join(finished, "id", "left_anti")
    stuck = todo.select("id", "trust", "audience", F.array_union("issues", F.array(F.lit("cycle"))).alias("issues"), "witnesses", F.lit(None).cast("int").alias("height"), F.lit(None).cast("bigint").alias("bound"))
    every = reduce(DataFrame.unionByName, levels).unionByName(stuck)
    over = every.where(F.col("bound") > max_nodes)
    if not over.isEmpty():
        sizes = closure(over.select(F.col("id").alias("root")), follow, max_depth, max_nodes).groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        every = every.join(sizes.withColumnRenamed("root", "id"), "id", "left")
    else:
        every = every.withColumn("size", F.col("bound"))
    limit = (F.coalesce("height", F.lit(0)) > max_depth) | (F.coalesce("size", F.lit(0)) > max_nodes)
    issues = F.array_sort(F.when(limit, F.array_union("issues", F.array(F.lit("limit")))).otherwise(F.col("issues")))
    clean = F.size("issues") == 0
    return every.withColumn("issues", issues).select(
        "id", clean.alias("complete"), F.when(F.col("trust") == 0, 0).when(~clean | (F.col("trust") == 1), 1).otherwise(2).alias("trust"),
        F.when(clean, F.col("audience")).otherwise(F.array().cast("array<string>")).alias("audience"), "issues", F.array_sort("witnesses").alias("witnesses"), "height",
    )


def closure(roots: DataFrame, follow: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int | None = None) -> DataFrame:
    """Distinct (root, node) pairs reachable from the roots, themselves included.

    With max_nodes a root with more nodes than that isn't followed on: its pairs are enough to show it. Each
    step's pairs are written once.
    """
    front = cut_lineage(roots.select("root", F.col("root").alias("node")).distinct())
    steps = [front]
    for _ in range(max_depth):
        seen = reduce(DataFrame.unionByName, steps)
        if max_nodes is not None:
            front = front.join(seen.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_nodes).select("root"), "root", "left_semi")
        step = front.join(follow.select(F.col("child").alias("node"), "parent"), "node").select("root", F.col("parent").alias("node")).distinct()
        front = cut_lineage(step.join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        steps.append(front)
    return reduce(DataFrame.unionByName, steps)


def resolve(records: DataFrame, now: float, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Evidence of every record of one namespace's snapshot; rows of several namespaces are refused."""
    names = records.agg(F.min("namespace").alias("first"), F.max("namespace").alias("last")).first()
    if names["first"] != names["last"]:
        raise ValueError("evidence is resolved for one namespace at a time")
    nodes, refs = nodes_and_refs(records, now)
    names = F.array(F.lit("untrusted"), F.lit("unknown"), F.lit("trusted"))
    return propagate(nodes, refs, max_nodes, max_depth).withColumn("trust", F.element_at(names, F.col("trust") + 1))


def allowed(audience, principal: str):
    return F.array_contains(audience, "*") | F.array_contains(audience, principal)


def derive(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Derived records: least trust, meet of audiences, least confidence of their parents.

    parents: current records. children: child (a key), text, source, anchor, kind, created_at and
    sources. A child without stored parents, or with parents of several namespaces, is an error.
    """
    from recordloom.functions import identity

    named = children.select("child", F.posexplode("sources").alias("pos", "s")).select("child", F.col("s.id").alias("id"), F.col("s.revision").alias("revision"))
    trust = F.when(F.col("trust") == "untrusted", 0).when(F.col("trust") == "unknown", 1).otherwise(2)
    joined = named.join(parents.select("namespace", "id", "revision", trust.alias("trust"), "audience", "confidence"), ["id", "revision"], "left")
    folded = joined.groupBy("child").agg(F.count_if(F.col("namespace").isNull()).alias("lost"), F.min("namespace").alias("namespace"), F.max("namespace").alias("other"), F.min("trust").alias("trust"), meet(F.collect_set("audience")).alias("audience"), F.min("confidence").alias("confidence"))
    folded = folded.withColumn("namespace", F.when(F.col("namespace") != F.col("other"), F.raise_error(F.lit("sources must share a namespace")).cast("string")).otherwise(F.col("namespace"))).drop("other")
    out = children.join(folded, "child", "left")
    absent = F.col("lost").isNull() | (F.col("lost") > 0)
    out = out.withColumn("namespace", F.when(absent, F.raise_error(F.lit("a parent isn't stored at that revision")).cast("string")).otherwise(F.col("namespace"))).drop("lost")
    names = F.array(F.lit("untrusted"), F.lit("unknown"), F.lit("trusted"))
    return out.withColumns({"trust": F.element_at(names, F.col("trust") + 1), "derived": F.lit(True), "id": identity.derived_id(F.col("namespace"), F.col("source"), F.col("anchor"), F.col("text"), F.col("sources"))})

"""Near-duplicate proposals: token Jaccard, greedy stars in id order, derived candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from recordloom.errors import whole
from recordloom.functions import text as tx
from recordloom.operators import pairing, provenance
from recordloom.session import cut_lineage

JACCARD, MAX_RECORDS = 0.7, 500


def similar(records: DataFrame, group: list[str], threshold: float = JACCARD) -> DataFrame:
    """Pairs a < b of one group whose word sets reach the threshold, with their similarity.

    Records with equal sets are one set until the end. Only sets that have enough of `pairing.keys` in common are compared, in
    cells that get each of their sets once. Words are compared by 64-bit hashes.
    """
    spark = records.sparkSession
    words = F.transform(tx.token_set(F.col("text")), lambda t: F.xxhash64(*group, t))
    full = records.dropna(subset=group).select(*group, "id", words.alias("words")).where(F.size("words") > 0)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema)
    seen = cut_lineage(full.mapInArrow(pairing.survey, f"{fields}, s bigint, s2 bigint, block bigint, chunk int, counts binary"))
    members = seen.where(F.col("chunk").isNull())
    counts = seen.where(F.col("chunk").isNotNull()).select("chunk", "counts").groupBy("chunk").applyInPandas(pairing.total, "chunk int, counts binary")
    rarity = spark.sparkContext.broadcast(pairing.sketch(counts.collect()))
    keys = members.select("s", "words").mapInArrow(pairing.keys(rarity, threshold), "key bigint, s bigint")
    found = keys.repartition(F.shiftright("key", 16)).sortWithinPartitions("key").mapInArrow(pairing.meet(threshold), "a bigint, b bigint, shared bigint")
    found = found.groupBy("a", "b").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= pairing.SHARED).drop("shared")
    # sets with the same least hash are one block, so that similar ones come to a cell in few copies; large blocks are cut both ways
    blocks = members.groupBy(F.col("s").alias("a")).agg(F.min("block").alias("block"))
    pairs = cut_lineage(found.join(blocks, "a"))
    block = F.pmod("block", F.lit(pairs.count() // pairing.CELL + 1))
    cuts = pairs.groupBy(block.alias("block")).agg(F.ceil(F.sqrt(F.count(F.lit(1)) / (2 * pairing.CELL))).alias("cuts"))
    cell = F.xxhash64("block", F.pmod("a", "cuts"), F.pmod("b", "cuts"))
    pairs = cut_lineage(pairs.withColumn("block", block).join(cuts, "block").select(cell.alias("cell"), "a", "b"))
    bits = pairs.mapInArrow(pairing.mark, "chunk int, bits binary").groupBy("chunk").applyInPandas(pairing.either, "chunk int, bits binary")
    asked = spark.sparkContext.broadcast(pairing.marks(bits.collect()))
    sets = members.select("s", "s2", "words").mapInArrow(pairing.marked(asked), "s bigint, s2 bigint, words array<bigint>").groupBy("s").agg(F.collect_set(F.struct("s2", "words")).alias("x"))
    places = pairs.select(F.col("cell").alias("place"), F.explode(F.array("a", "b")).alias("s")).distinct()
    held = places.join(sets, "s").select("place", "s", F.inline("x"))
    near = pairs.groupBy("cell").cogroup(held.groupBy("place")).applyInPandas(pairing.compare(threshold), "a bigint, a2 bigint, b bigint, b2 bigint, jaccard double")
    left = members.select(*group, F.col("id").alias("x"), F.col("s").alias("a"), F.col("s2").alias("a2"))
    right = members.select(F.col("id").alias("y"), F.col("s").alias("b"), F.col("s2").alias("b2"))
    different = near.join(left, ["a", "a2"]).join(right, ["b", "b2"]).where("x <> y")
    equal = left.join(right, (F.col("a") == F.col("b")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y"))).withColumn("jaccard", F.lit(1.0))
    both = different.select(*group, "x", "y", "jaccard").unionByName(equal.select(*group, "x", "y", "jaccard"))
    return both.select(*group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def clusters(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Greedy stars: in id order, a record not yet taken takes its partners not yet taken. Group, seed, id."""
    fields = pairs.select(*group).schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for a, mine in pdf.sort_values(["a", "b"]).groupby("a", sort=True):
            if a in used:
                continue
            members = [b for b in mine["b"] if b not in used]
            if members:
                used |= {a, *members}
                out += [(a, x) for x in (a, *members)]
        found = pd.DataFrame(out, columns=["seed", "id"])
        for name in reversed(fields.names):
            found.insert(0, name, [pdf[name].iloc[0]] * len(found))
        return found

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return pairs.groupBy(*group).applyInPandas(fold, f"{schema}, seed string, id string")


def propose(records: DataFrame, now: float, max_records: int = MAX_RECORDS, max_nodes: int = provenance.MAX_NODES, max_depth: int = provenance.MAX_DEPTH, evidence: DataFrame | None = None) -> DataFrame:
    """Candidates made of near-duplicate derived, trusted records of one audience; nothing is written.

    ready is false where the candidate's own closure breaks a bound (reason provenance_limit).
    """
    whole(max_records, "max_records")
    ev = provenance.resolve(records, now, max_nodes, max_depth) if evidence is None else evidence
    good = ev.where(F.col("complete") & (F.col("trust") == "trusted")).select("id", F.array_join("audience", "\x00").alias("circle"), "height")
    fit = records.where(F.col("derived") & (F.col("source") != "consolidation")).join(good, "id")
    if fit.limit(max_records + 1).count() > max_records:
        raise ValueError("consolidation candidate limit exceeded")
    stars = clusters(similar(fit, ["circle", "kind"]), ["circle", "kind"])
    members = stars.join(fit.select("id", "revision", "text", "confidence", "height"), "id")
    made = members.groupBy("circle", "kind", "seed").agg(
        F.max_by("text", F.struct("confidence", F.length("text"), "id")).alias("text"),
        F.array_sort(F.collect_list(F.struct("id", "revision"))).alias("sources"), F.max("height").alias("height"),
    )
    anchor = F.array_join(F.transform("sources", lambda s: F.concat(s["id"], F.lit(":"), s["revision"].cast("string"))), "|")
    children = made.select(F.concat_ws("\x00", "circle", "kind", "seed").alias("child"), "text", F.lit("consolidation").alias("source"), anchor.alias("anchor"), "kind", F.lit(float(now)).alias("created_at"), "sources", (F.col("height") + 1 <= max_depth).alias("ready"))
    out = provenance.derive(records, children)
    return out.withColumn("reason", F.when(~F.col("ready"), "provenance_limit")).drop("child", "anchor")

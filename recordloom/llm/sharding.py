"""K-d tree partitioning of documents into shards of near-equal bytes.

Only DataFrame functions are used. Documents become a narrow table (no text):
id, size, checksum, digest and metadata. Equal texts form a unit and stay in one
shard, unless they weigh more than UNIT_SHARE of a shard; then the group is
dealt into parts below that weight, so that a group that holds a third of all
rows can't unbalance a shard. The tree splits units: at each node the dimension
that is widest, as a share of its extent over the whole table, is split at the
weighted median, until a leaf holds the target bytes. A median is found by
counting bytes in BINS equal steps of the node's extent, then within the step
that holds it, and so on: what reaches the driver is at most BINS sums for each
open node, whatever the size of the table.

Dimensions: log2 of the size, source, language and doc_id. Each coordinate is an
integer whose low bits are a hash of the unit, so that ties (one source with a
third of the rows) split as well as anything else.

Defined cases: a null text has size 1, checksum 0 and is a text of its own kind
(equal to the empty text); null metadata takes the lowest coordinate; repeated
rows are placed one by one; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

BINS = 4096
#: A group of equal texts above this share of a shard's target is dealt into parts.
UNIT_SHARE = 0.05
#: A median's step may hold this share of the node's bytes before it is taken as found.
PRECISE = 0.0005
ROWS_PER_SLOT_RANGE = 50_000
_LOW_BITS = 20
DIMENSIONS = ["x_size", "x_source", "x_lang", "x_doc"]


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    have = set(docs.columns)
    extra = [F.col(c).alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"), *extra)


def _coordinate(value: Column) -> Column:
    """value (an integer of at most 40 bits) above the unit's hash bits."""
    return F.shiftleft(F.coalesce(value, F.lit(0)).cast("long"), _LOW_BITS) + F.pmod(F.xxhash64("digest", "part"), F.lit(1 << _LOW_BITS))


def _case(column: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def _medians(units: DataFrame, nodes: dict[int, dict]) -> None:
    """Sets nodes[n]['at']: units with a coordinate below it weigh about nodes[n]['share'] of the node."""
    for n in nodes.values():
        n |= {"lo": n["min"], "hi": n["max"] + 1, "below": 0, "at": None}
    while work := {k: n for k, n in nodes.items() if n["at"] is None}:
        node, x = F.col("node"), _case(F.col("node"), {k: F.col(n["dim"]) for k, n in work.items()}, None)
        lo, hi = (_case(node, {k: F.lit(n[e]) for k, n in work.items()}, None) for e in ("lo", "hi"))
        step = F.greatest(F.lit(1), F.ceil((hi - lo) / F.lit(BINS)).cast("long"))
        inside = units.select("node", "w", x.alias("x"), lo.alias("lo"), hi.alias("hi"), step.alias("step")).where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
        counted = inside.groupBy("node", F.floor((F.col("x") - F.col("lo")) / F.col("step")).cast("long").alias("bin")).agg(F.sum("w").alias("w")).orderBy("node", "bin").collect()
        for k, n in work.items():
            size = max(1, -(-(n["hi"] - n["lo"]) // BINS))
            want, below = n["share"] * n["w"], n["below"]
            for _, b, w in (r for r in counted if r[0] == k):
                start = n["lo"] + b * size
                if below + w >= want:
                    if size == 1 or w <= PRECISE * n["w"]:
                        n["at"] = start + size if want - below > below + w - want else start
                    else:
                        n["lo"], n["hi"], n["below"] = start, min(start + size, n["hi"]), below
                    break
                below += w
            else:
                n["at"] = n["hi"]


def tree(units: DataFrame, leaves: int) -> list[dict[int, dict]]:
    """The splits of each level. A node with m leaves gives m // 2 of them to its left child."""
    root = units.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max))).first()
    extent = {c: max(1, (root[f"max_{c}"] or 0) - (root[f"min_{c}"] or 0)) for c in DIMENSIONS}
    levels, now, holds = [], units.withColumn("node", F.lit(1)), {1: leaves}
    while any(m > 1 for m in holds.values()):
        stats = now.groupBy("node").agg(F.sum("w").alias("w"), *(f(c).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max))).collect()
        nodes = {}
        for s in stats:
            if holds[s["node"]] > 1:
                dim = max(DIMENSIONS, key=lambda c: (s[f"max_{c}"] - s[f"min_{c}"]) / extent[c])
                nodes[s["node"]] = {"dim": dim, "min": s[f"min_{dim}"], "max": s[f"max_{dim}"], "w": s["w"], "share": holds[s["node"]] // 2 / holds[s["node"]]}
        _medians(now, nodes)
        levels.append(nodes)
        now = now.withColumn("node", _descend(F.col("node"), nodes))
        split = {k: m for k, m in holds.items() if m > 1}
        holds = {k: m for k, m in holds.items() if m == 1} | {2 * k: m // 2 for k, m in split.items()} | {2 * k + 1: m - m // 2 for k, m in split.items()}
    levels.append({k: {"leaf": i} for i, k in enumerate(sorted(holds, key=lambda k: bin(k)[2:].ljust(64, "0")))})
    return levels


def _descend(node: Column, nodes: dict[int, dict]) -> Column:
    return _case(node, {k: F.when(F.col(n["dim"]) < n["at"], F.lit(2 * k)).otherwise(F.lit(2 * k + 1)) for k, n in nodes.items()}, None) if nodes else node


def shards(docs: DataFrame, count: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    rows = materialise(_narrow(docs))
    total = rows.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    weight, low, high, n_rows = total[0] or 1, total[1] or 0, total[2] or 0, total[3]
    count = count or max(1, -(-weight // target_bytes))
    limit = max(1, int(UNIT_SHARE * weight / count))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("group_bytes"))
    heavy = groups.where(F.col("group_bytes") > limit)  # at most weight / limit groups: count / UNIT_SHARE
    parted = rows.join(F.broadcast(heavy), "digest", "left").withColumn("part", F.when(F.col("group_bytes").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("group_bytes") / limit))).cast("long"))
    span = max(1, high - low)
    place = ((F.col("doc_id") - low).cast("double") / F.lit(float(span)) * F.lit(float(1 << 32))).cast("long")
    units = parted.groupBy("digest", "part").agg(F.sum("size").alias("w"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min(place).alias("place"), F.max("size").alias("one"))
    units = materialise(units.select("digest", "part", "w", _coordinate(F.log2("one") * F.lit(float(1 << 24))).alias("x_size"), _coordinate(F.crc32("source")).alias("x_source"), _coordinate(F.crc32("lang")).alias("x_lang"), _coordinate(F.col("place")).alias("x_doc")))
    placed = units.withColumn("node", F.lit(1))
    levels = tree(units, count)
    for nodes in levels[:-1]:
        placed = placed.withColumn("node", F.when(F.col("node").isin(list(nodes)), _descend(F.col("node"), nodes)).otherwise(F.col("node")))
    leaf = placed.select("digest", "part", _case(F.col("node"), {k: F.lit(n["leaf"]) for k, n in levels[-1].items()}, None).cast("int").alias("shard"))
    ranges = max(1, n_rows // count // ROWS_PER_SLOT_RANGE)
    found = parted.join(leaf, ["digest", "part"]).select("doc_id", "size", "text_crc32", "digest", "shard", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(ranges)).alias("range"))
    found = materialise(found)
    sizes = found.groupBy("shard", "range").count()
    before = sizes.select("shard", "range", (F.sum("count").over(Window.partitionBy("shard").orderBy("range")) - F.col("count")).alias("before"))
    numbered = found.withColumn("place", F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "digest")) - 1)
    return numbered.join(before, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"))


def op9(spark, sf_dir: str) -> DataFrame:
    found = shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), count=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

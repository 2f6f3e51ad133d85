"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its runs of five words (lower case; a text of one
to four words is one run). Weight: frequency in the text times inverse document
frequency, relative to that of a run in FULL_SHARE of all documents and capped
at 1. So a run weighs the same in every text, and fully unless more than
FULL_SHARE of the documents have it: neither a group of thousands of near copies
nor a passage that many texts share makes the edits of a copy look larger than
they are. A passage that most texts share counts for less.

Document frequencies come from a count-min sketch of fixed size over all
documents; its error is a fixed share of the corpus, so the weights behave
alike at every size. Improved consistent weighted sampling (Ioffe, 2010) draws
SAMPLES samples; ROWS of them make a band. Texts that share a band meet the
most central of their bucket, whose runs are the commonest: among copies edited
here and there, the least edited one. The weighted Jaccard similarity is
computed for these pairs. A text that fails there is compared with the others of
its bucket, unless both are connected already or one of three exact bounds
excludes a link: the triangle inequality of the Jaccard distance, the weight of
runs that only one text at hand has, or the number of full-weight runs that one
of the two has and the other lacks. The bounds are join conditions, so that only
pairs that are likely links become rows. Linked texts are joined to classes by star contraction.
So a group costs its size, not its square, and no link inside a bucket between
unconnected texts is passed over. Equal texts are one node throughout.

Defined cases: null counts as empty; texts without words are alike only if
equal; repeated rows share a class; a class without any doc_id has class_id
null; an empty table gives no rows; further columns are ignored by `classes`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import words
from .common import bounded_batches, join_dealt, materialise, release, strings
from .components import components

U = np.uint64
WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 5
SAMPLES = BANDS * ROWS
WIDTH, DEPTH, SLICES, SPREAD = 1 << 21, 2, 64, 32
#: A run counts fully if no more than this share of all documents have it.
FULL_SHARE = 1 / 3
PAIRS_PER_SALT = 2_000
#: Members of a bucket, after the most central, that texts which failed with that one are compared with first.
PIVOTS = 8


def runs(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashes of the runs of each text, with repeats; none for a text without words."""
    for lo, hi in words.chunks(texts):
        b = words.batch([x.lower() for x in texts[lo:hi]])
        h, at = words.windows(b, WORDS)
        cuts = np.searchsorted(b.owner[at], np.arange(hi - lo + 1))
        for i in range(hi - lo):
            first, last = b.first[i], b.first[i + 1]
            if 0 < last - first < WORDS:
                yield words.mix(np.cumsum(b.hashes[first:last] * U(0x2545F4914F6CDD1D))[-1:] + U(int(last - first)))
            else:
                yield h[cuts[i] : cuts[i + 1]]


def _cells(h: np.ndarray) -> list[np.ndarray]:
    return [(h * U(c) >> U(64 - 21)).astype(np.int64) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _pack(a: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(a) or a.max() <= np.iinfo(k).max)
    return kind.encode() + zlib.compress(a.astype(kind).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[3:]), data[:3].decode()).astype(np.int64)


def sketch(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The DEPTH x WIDTH counts of documents per cell, and the number of documents.

    Tasks sum what they read, slices are summed over tasks in two steps, and the
    driver gets the finished sketch, whose size is fixed.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        table, n, part = np.zeros((DEPTH, WIDTH), np.int64), 0, 0
        part = TaskContext.get().partitionId()
        for pdf in batches:
            n += len(pdf)
            for h in runs(strings(pdf["text"])):
                once = np.unique(h)
                for row, cell in zip(table, _cells(once)):
                    np.add.at(row, cell, 1)
        if n:
            step = DEPTH * WIDTH // SLICES
            flat = table.reshape(-1)
            yield pd.DataFrame({"slice": range(SLICES), "turn": part % SPREAD, "n": n, "data": [_pack(flat[i * step : (i + 1) * step]) for i in range(SLICES)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(map(_unpack, pdf["data"]))
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "turn": [0], "n": [pdf["n"].sum()], "data": [_pack(total)]})

    kind = "slice int, turn int, n long, data binary"
    parts = docs.select("text").mapInPandas(count, kind).groupBy("slice", "turn").applyInPandas(add, kind).groupBy("slice").applyInPandas(add, kind)
    rows = sorted(parts.collect())
    if not rows:
        return np.zeros((DEPTH, WIDTH), np.uint32), 0
    return np.concatenate([_unpack(r["data"]) for r in rows]).reshape(DEPTH, WIDTH).astype(np.uint32), rows[0]["n"]


def weigh(h: np.ndarray, table: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs, sorted, and their weights."""
    once, tf = np.unique(h, return_counts=True)
    if not len(once):
        return once, np.zeros(0)
    df = np.minimum(*(row[cell] for row, cell in zip(table, _cells(once)))).astype(np.float64)
    idf = np.log1p(n_docs / np.maximum(df, 1))
    return once, tf * np.minimum(1.0, idf / np.log1p(1 / FULL_SHARE))


def _centrality(h: np.ndarray, table: np.ndarray) -> float:
    """Mean log document frequency of a text's runs."""
    once = np.unique(h)
    return float(np.log(np.maximum(1, np.minimum(*(row[cell] for row, cell in zip(table, _cells(once)))))).mean()) if len(once) else 0.0


def jaccard(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two weighed texts; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


_SEEDS = words.mix(np.arange(1, SAMPLES + 1))


def sample(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The band values of one weighed text (not empty), as signed 64-bit integers."""
    best, chosen, levels = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, U), np.zeros(SAMPLES, np.int64)
    columns = np.arange(SAMPLES)
    for lo in range(0, len(h), 512):
        part, log_w = h[lo : lo + 512], np.log(w[lo : lo + 512]).astype(np.float32)[:, None]
        z = (part[:, None] ^ _SEEDS) * U(0xBF58476D1CE4E5B9)
        z ^= z >> U(32)
        z *= U(0x94D049BB133111EB)
        z ^= z >> U(29)
        y = z * U(0xD6E8FEB86659FD93)
        y ^= y >> U(32)
        half = np.float32(2.0**-32)
        u = lambda x: (x.astype(np.uint32).astype(np.float32) + np.float32(0.5)) * half
        r = -np.log(u(z) * u(z >> U(32)))
        c = -np.log(u(y) * u(y >> U(32)))
        beta = (z * U(0x9FB21C651E98DF25) >> U(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        a = np.log(c) - r * (t - beta + np.float32(1))
        at = a.argmin(0)
        least = a[at, columns]
        better = least < best
        best[better], chosen[better], levels[better] = least[better], part[at[better]], t[at, columns][better].astype(np.int64)
    drawn = words.mix(chosen + levels.astype(U) * U(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1).astype(U)
    for i in range(ROWS):
        out = words.mix(out * U(0x2545F4914F6CDD1D) + drawn[:, i])
    return out.view(np.int64)


def _node(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _verified(pairs: DataFrame, texts: DataFrame, shared, n_docs: int) -> DataFrame:
    """(a, b) with their similarity. An `a` with many partners is dealt over several tasks."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_SALT).cast("int").alias("salts"))
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b").join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    right = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")).join(salts, "a").select("a", "a_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        table, last, kept = shared.value, None, None
        for pdf in batches:
            theirs = runs(strings(pdf["b_text"]))
            out = []
            for a, text, h in zip(pdf["a"], pdf["a_text"], theirs):
                if a != last:
                    last, kept = a, weigh(next(runs([text])), table, n_docs)
                out.append(jaccard(kept, weigh(h, table, n_docs)))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "sim": out})

    return left.join(right, ["a", "salt"]).select("a", "b", "a_text", "b_text").mapInPandas(compare, "a binary, b binary, sim double")


def _bounds(far: DataFrame, failed: DataFrame, held: DataFrame, shared, n_docs: int) -> DataFrame:
    """Total weight, weight of a text's own runs, its runs and those of weight 1 or more, for each node in a bucket with a failure.

    A sketch over the texts of these buckets bounds from above in how many of them a run occurs, so that a
    run counted once is the text's own.
    """
    at_hand = far.join(failed.select("bucket").distinct(), "bucket", "left_semi")
    at_hand = at_hand.select("node").unionByName(at_hand.select(F.col("head").alias("node"))).distinct()
    mates = materialise(held.join(at_hand, "node", "left_semi").dropDuplicates(["node"]))
    seen, _ = sketch(mates)
    own = far.sparkSession.sparkContext.broadcast(seen)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            out = []
            for h in runs(strings(pdf["text"])):
                once, w = weigh(h, shared.value, n_docs)
                df = np.minimum(*(row[cell] for row, cell in zip(own.value, _cells(once))))
                out.append((float(w.sum()), float(w[df <= 1].sum()), once[w >= 1].view(np.int64), once.view(np.int64)))
            yield pd.DataFrame(out, columns=["total", "own", "full", "runs"]).assign(node=pdf["node"].to_numpy())[["node", "total", "own", "full", "runs"]]

    return mates.select("node", "text").mapInPandas(bound, "node binary, total double, own double, full array<long>, runs array<long>")


def links(docs: DataFrame) -> DataFrame:
    """Verified links between different texts, as nodes (u, v): enough of them to connect every class."""
    with bounded_batches(docs.sparkSession):
        return _links(docs)


def _links(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    table, n_docs = sketch(texts)
    shared = spark.sparkContext.broadcast(table)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            weighed = [weigh(h, shared.value, n_docs) for h in runs(strings(pdf["text"]))]
            out = pd.DataFrame({"node": pdf["node"], "center": [_centrality(h, shared.value) for h, _ in weighed], "bands": [sample(h, w) if len(h) else None for h, w in weighed]})
            yield out[out["bands"].notna()]

    drawn = texts.select(_node(F.col("text")).alias("node"), "text").mapInPandas(draw, "node binary, center double, bands array<long>")
    members = materialise(drawn.select("node", "center", F.explode("bands").alias("bucket")).distinct())
    buckets = members.groupBy("bucket").agg(F.max(F.struct("center", "node"))["node"].alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = materialise(members.join(buckets, "bucket").select("bucket", "head", "node", "center"))
    pairs = placed.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    wanted = placed.select("node").distinct()
    one = docs.select(_node(F.col("text")).alias("node"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")).groupBy("node").agg(F.min("id").alias("id"))
    full = docs.select(_node(F.col("text")).alias("node"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    held = materialise(full.join(one.join(wanted, "node", "left_semi"), ["node", "id"]).select("node", "text"))
    sims = materialise(_verified(pairs, held, shared, n_docs))
    edges = sims.where(F.col("sim") >= SIMILARITY).select(F.col("a").alias("u"), F.col("b").alias("v"))

    far = materialise(placed.join(sims.select(F.col("a").alias("head"), F.col("b").alias("node"), "sim"), ["head", "node"]))
    failed = far.where(F.col("sim") < SIMILARITY)
    profile = _bounds(far, failed, held, shared, n_docs)
    far = far.join(profile, "node").where((F.col("sim") >= SIMILARITY) | (F.col("total") - F.col("own") >= (SIMILARITY - 1e-9) * F.col("total")))
    far = materialise(far)
    side = lambda df, x: df.select("bucket", F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("sim", "total", "own", "full", "runs")))
    failed, near = materialise(side(far.where(F.col("sim") < SIMILARITY), "a")), side(far, "b")
    if failed.isEmpty():
        return edges
    # first against the next most central members of the bucket, then against all that are still apart
    busy = placed.join(failed.select("bucket").distinct(), "bucket", "left_semi").where("node <> head")
    order = Window.partitionBy("bucket").orderBy(F.desc("center"), "node")
    pivots = busy.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS).select("bucket", F.col("node").alias("b"))
    edges = _also_linked(failed.join(pivots, "bucket").select("a", "b"), edges, held, shared, n_docs)
    roots = materialise(components(edges))
    root = lambda df, x: df.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x, "left").withColumn(f"{x}_root", F.coalesce(f"{x}_root", x))
    apart = F.col("a_root") != F.col("b_root")
    within = F.abs(F.col("a_sim") - F.col("b_sim")) <= 1 - SIMILARITY + 1e-9
    enough = lambda x, y: F.col(f"{x}_total") - F.col(f"{x}_own") >= (SIMILARITY - 1e-9) * (F.col(f"{x}_total") + F.col(f"{y}_own"))
    once = (F.col("b_sim") >= SIMILARITY) | (F.col("a") < F.col("b"))
    lacks = lambda x, y: F.size(F.array_except(f"{x}_full", f"{y}_runs"))
    missed = lambda x, y: F.col(f"{x}_total") - lacks(x, y) >= (SIMILARITY - 1e-9) * (F.col(f"{x}_total") + lacks(y, x))
    rest = root(failed, "a").join(root(near, "b"), "bucket").where(apart & within & once & enough("a", "b") & enough("b", "a") & missed("a", "b") & missed("b", "a"))
    return _also_linked(rest.select("a", "b"), edges, held, shared, n_docs)


def _also_linked(pairs: DataFrame, edges: DataFrame, held: DataFrame, shared, n_docs: int) -> DataFrame:
    """The edges, with those pairs (a, b) that link two components."""
    pairs = pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = materialise(components(edges))
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    apart = materialise(apart.select("a", "b").distinct())
    if apart.isEmpty():
        return edges
    more = materialise(_verified(apart, held, shared, n_docs).where(F.col("sim") >= SIMILARITY))
    return materialise(edges.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the text) and class_id, the smallest doc_id of the class, for every row."""
    rows = materialise(docs.select("doc_id", _node(F.col("text")).alias("node")))
    linked = components(links(docs))
    own = rows.groupBy("node").agg(F.min("doc_id").alias("own"))
    rooted = materialise(linked.join(own, "node"))
    least = rooted.join(own.withColumnsRenamed({"node": "root", "own": "root_own"}), "root").groupBy("root").agg(F.least(F.min("own"), F.first("root_own")).alias("class_id"))
    least = materialise(least)
    # the members of a class, then its root, and for all other texts their own smallest id
    grouped = join_dealt(rooted.select("node", "root"), least, "root").select("node", "class_id").unionByName(least.withColumnRenamed("root", "node"))
    of_node = own.join(materialise(grouped), "node", "left").select("node", F.coalesce("class_id", "own").alias("class_id"))
    return join_dealt(rows, of_node, "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each class (of equal ids, that with the smallest digest), all columns."""
    found = materialise(classes(docs).withColumn("class", F.coalesce("class_id", F.xxhash64("node"))))
    chosen = found.groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "node")).alias("x")).select("x.id", "x.node")
    id_of, node = F.coalesce("doc_id", F.lit(-(1 << 63))), _node(F.col("text"))
    kept = docs.join(chosen.withColumnsRenamed({"id": "__chosen_id", "node": "__chosen_node"}), (id_of == F.col("__chosen_id")) & (node == F.col("__chosen_node")), "left_semi")
    repeats = found.groupBy("doc_id", "node").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept


def op5(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id")

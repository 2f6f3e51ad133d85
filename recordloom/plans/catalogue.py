"""Registry of the engine's queries; the DuckDB SQL that checks them is in oracles.py."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from recordloom.functions import identity, text as tx
from recordloom.operators import canonical, consolidation, graph, ledger, packing, provenance, recall as rc, search
from recordloom.plans.oracles import ORACLES, QUERY
from recordloom.schema import first_bad_field
from recordloom.session import cut_lineage, shared_path
from recordloom.sources import corpus
from recordloom.sources.corpus import NOW, PRINCIPAL, table
from recordloom.streaming import ingest

__all__ = ["ORACLES", "QUERIES"]


def _judged(spark, d):
    records = corpus.documents(spark, d)
    return rc.eligible(records, PRINCIPAL, NOW, rc.own_evidence(records, NOW))


def record_ids(spark, d):
    return corpus.documents(spark, d).select("doc_id", "id")


def ingest_fingerprint(spark, d):
    none, no_refs = F.array().cast("array<string>"), F.array().cast("array<struct<id:string,revision:bigint>>")
    null = F.lit(None).cast("double")
    fields = {
        "id": F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")), "text": F.concat_ws(" ", "c_name", "c_mktsegment"), "namespace": F.lit("default"),
        "source": F.lit("manual"), "author": F.lit(None).cast("string"), "kind": F.lit("fact"), "trust": F.lit("unknown"), "audience": none, "sources": no_refs,
        "derived": F.lit(False), "complete": F.lit(True), "confidence": F.lit(1.0), "occurred_at": null, "expires_at": null, "status": F.lit("active"),
    }
    return table(spark, d, "customer").select("c_custkey", identity.fingerprint(fields, integral=True).alias("fingerprint"))


def derive_records(spark, d):
    """Each order derived from its customer and that customer's nation."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    star = F.array(F.lit("*"))
    cust = c.select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 3 == 0, "untrusted").when(F.col("c_custkey") % 3 == 1, "unknown").otherwise("trusted").alias("trust"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("boss"), F.lit("worker"))).otherwise(star).alias("audience"), ((F.col("c_custkey") % 10) / 10.0).alias("confidence"))
    nat = n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("trusted").alias("trust"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("worker"))).otherwise(star).alias("audience"), F.lit(0.5).alias("confidence"))
    parents = cust.unionByName(nat).withColumns({"namespace": F.lit("tpch"), "revision": F.lit(1).cast("bigint")})
    o = table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    ref = lambda prefix, col: F.struct(F.concat(F.lit(prefix), F.col(col).cast("string")).alias("id"), F.lit(1).cast("bigint").alias("revision"))
    children = o.select(F.col("o_orderkey").alias("child"), F.col("o_orderpriority").alias("text"), F.lit("derived").alias("source"), F.col("o_orderkey").cast("string").alias("anchor"), F.array(ref("nation:", "c_nationkey"), ref("cust:", "o_custkey")).alias("sources"))
    return provenance.derive(parents, children).select(F.col("child").alias("o_orderkey"), "id", "trust", F.array_join("audience", ",").alias("audience"), "confidence")


def latest_revision(spark, d):
    return ledger.latest(corpus.versions(spark, d)).select("id", "revision", "text", "event_id")


def revision_as_requested(spark, d):
    history = corpus.versions(spark, d)
    asked = history.select("namespace", "id").distinct().withColumn("revision", (F.element_at(F.split("id", ":"), 2).cast("bigint") % 5) + 1)
    return ledger.at_revision(history, asked).select("id", "revision", "text")


def cas_put_outcomes(spark, d):
    writes = table(spark, d, "events").select(F.lit("events").alias("namespace"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("pos"), (F.col("event_id") % 4).alias("expected"))
    none = writes.where("false").select("namespace", "id", F.lit(0).cast("bigint").alias("revision"))
    return ledger.compare_and_swap(writes, none).select("id", "pos", "accepted", "revision")


def validate_records(spark, d):
    n = F.col("doc_id")
    rows = corpus.documents(spark, d).withColumns({
        "kind": F.when(n % 19 == 1, "").otherwise(F.col("kind")), "confidence": F.when(n % 23 == 2, 1.5).when(n % 29 == 3, F.lit(float("nan"))).otherwise(F.col("confidence")),
        "trust": F.when(n % 31 == 4, "certain").otherwise(F.col("trust")), "audience": F.when(n % 37 == 5, F.array(F.lit("*"), F.lit("worker"))).otherwise(F.col("audience")), "revision": F.when(n % 41 == 6, F.lit(-1)).otherwise(F.col("revision")),
    })
    return rows.select("doc_id", first_bad_field().alias("bad_field"))


def lexical_overlap(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.overlap(F.col("text"), QUERY).alias("overlap"))


def lexical_rank_topk(spark, d):
    hits = rc.lexical(_judged(spark, d), QUERY, NOW)
    return hits.select("doc_id", "overlap", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def token_sets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.token_set(F.col("text"))).alias("n_tokens"))


def classify_kinds(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.classify_kind(F.col("text")).alias("kind"))


def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.redact_secrets(F.col("text"))).alias("redacted_md5"))


def access_filter(spark, d):
    return _judged(spark, d).select("doc_id", F.coalesce("reason", F.lit("eligible")).alias("reason"))


def exclusion_counts(spark, d):
    return rc.counts(_judged(spark, d))


def _evidence(spark, d):
    nodes, refs = corpus.shipments(spark, d)
    issues = F.filter(F.array(F.when(F.col("inactive"), "inactive"), F.when(F.col("incomplete"), "incomplete")), lambda x: x.isNotNull())
    nodes = nodes.select("id", "trust", "audience", issues.alias("issues"), F.col("id").startswith("region:").alias("witness"))
    return provenance.propagate(nodes, refs.withColumn("issue", F.lit(None).cast("string")))


def provenance_evidence(spark, d):
    return _evidence(spark, d).select("id", "complete", "trust", F.array_join("audience", ",").alias("audience"), F.array_join("issues", ",").alias("issues"), F.array_join("witnesses", ",").alias("witnesses"), "height")


def provenance_closure(spark, d):
    nodes, refs = corpus.shipments(spark, d)
    return provenance.closure(nodes.where(F.col("id").startswith("ship:")).select(F.col("id").alias("root")), refs.select("child", "parent"))


def bm25_topk(spark, d):
    index = search.index(corpus.documents(spark, d))
    best = search.candidates(index, QUERY, 50).join(record_ids(spark, d), "id")
    return best.select("doc_id", F.round("bm25", 9).alias("bm25"), "position")


def hybrid_fusion(spark, d):
    records = corpus.documents(spark, d)
    judged = _judged(spark, d)
    fit = judged.where("reason is null")
    best = search.candidates(search.index(records), QUERY, 100).join(fit.select("id", "revision"), ["id", "revision"], "left_semi")
    both = rc.lexical(judged, QUERY, NOW).select("id", "score").unionByName(best.select("id", (1 / (60 + F.col("position"))).alias("score"))).groupBy("id").agg(F.round(F.sum("score"), 9).alias("score"))
    return both.join(records.select("id", "doc_id"), "id").select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(20)


def _edges(spark, d):
    """Edges whose backing record is eligible: customers by sound evidence, others always."""
    edges = corpus.concept_edges(spark, d)
    good = _evidence(spark, d).where(F.col("complete") & provenance.allowed(F.col("audience"), PRINCIPAL)).select("id", F.lit(1).cast("bigint").alias("revision"))
    return graph.usable(edges, good)


def _scored(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("supp:"), F.col("s_suppkey").cast("string")).alias("id"))


def edge_eligibility(spark, d):
    return _edges(spark, d).select("source", "relation", "target", "record_id", "weight")


def graph_seeds(spark, d):
    return graph.seeds(_edges(spark, d), _scored(spark, d), 1_000_000)


def fanout_topk(spark, d):
    return graph.ranked(_edges(spark, d), 5).select("node", "other", "record_id", "weight", "edge_rank")


def graph_expand(spark, d):
    """Two levels with bounds that don't bind but for the fanout."""
    return graph.expand(cut_lineage(_edges(spark, d)), _scored(spark, d), depth=2, fanout=25, max_nodes=1_000_000).select("id", F.round("graph", 9).alias("graph"))


def recall_full(spark, d):
    records = corpus.documents(spark, d)
    hits = rc.recall(records, QUERY, PRINCIPAL, NOW, index=search.index(records), evidence=rc.own_evidence(records, NOW), limit=20, excerpt_chars=400)
    return hits.select("doc_id", F.round("score", 9).alias("score"), F.array_join("routes", ",").alias("routes"), F.col("resolved_trust").alias("trust"))


def excerpt_hits(spark, d):
    """The passages that recall shows of its best documents."""
    records = corpus.documents(spark, d)
    hits = rc.recall(records, QUERY, PRINCIPAL, NOW, evidence=rc.own_evidence(records, NOW), limit=20, excerpt_chars=400)
    return hits.select("doc_id", "excerpt")


def context_pack(spark, d):
    hits = rc.lexical(_judged(spark, d), QUERY, NOW).withColumn("excerpt", F.col("text"))
    top = hits.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(20)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return packing.pack(placed, 6000).select(F.md5("text").alias("text_md5"), F.size("included").alias("n_included"), F.size("omitted").alias("n_omitted"), "used")


def jaccard_pairs(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "text")
    pairs = consolidation.similar(rows, ["lang"])
    return pairs.select(F.least(F.col("a").cast("bigint"), F.col("b").cast("bigint")).alias("a"), F.greatest(F.col("a").cast("bigint"), F.col("b").cast("bigint")).alias("b"), F.round("jaccard", 9).alias("jaccard"))


def consolidation_proposals(spark, d):
    """Benchmark items, each derived from a region record, with a copy of every fifth: pairs are proposed."""
    b = table(spark, d, "benchmark")
    copy = b.where("item_id % 5 = 0").select((F.col("item_id") + 1_000_000).alias("item_id"), "text")
    star, none = F.array(F.lit("*")), F.array().cast("array<struct<id:string,revision:bigint>>")
    base = {"namespace": F.lit("bench"), "revision": F.lit(1).cast("bigint"), "source": F.lit("derived"), "author": F.lit(None).cast("string"), "kind": F.lit("fact"), "trust": F.lit("trusted"), "audience": star, "complete": F.lit(True), "confidence": F.lit(0.75), "created_at": F.lit(0.0), "occurred_at": F.lit(None).cast("double"), "expires_at": F.lit(None).cast("double"), "status": F.lit("active")}
    atoms = b.unionByName(copy).select(F.lpad(F.col("item_id").cast("string"), 10, "0").alias("id"), "text").withColumns(base | {"derived": F.lit(True), "sources": F.array(F.struct(F.lit("root").alias("id"), F.lit(1).cast("bigint").alias("revision")))})
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit("root").alias("text")).withColumns(base | {"derived": F.lit(False), "sources": none})
    found = consolidation.propose(atoms.unionByName(root), NOW, max_records=1_000_000)
    return found.select("id", F.transform("sources", lambda s: s["id"]).cast("string").alias("members"), "confidence", "trust", "ready")


def _items(spark, d):
    e = table(spark, d, "events")
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    text = F.concat_ws(" ", "event_type", "props")
    return e.select(F.lit("events").alias("namespace"), user.alias("id"), F.col("event_id").alias("pos"), text.alias("text"), F.sha2(F.concat_ws("|", user, text), 256).alias("fingerprint"), F.concat_ws(".", user, F.sha2(text, 256)).alias("operation_id"))


def ingest_batch_outcomes(spark, d):
    items = _items(spark, d)
    none = items.where("false").select("namespace", "id", F.lit(0).alias("revision"), "text")
    return ledger.ingest(items, none, ["text"]).select("id", "pos", "outcome", "revision")


def ingest_checkpoint_replay(spark, d):
    items = _items(spark, d)
    none = items.where("false").select("namespace", "id", F.lit(0).alias("revision"), "text")
    outcomes = ledger.ingest(items, none, ["text"])
    return ledger.replay(items, outcomes).select("operation_id", "pos", "outcome", "revision", "replayed")


def ingest_receipts(spark, d):
    items = _items(spark, d)
    none = items.where("false").select("namespace", "id", F.lit(0).alias("revision"), "text")
    return ledger.receipts(ledger.replay(items, ledger.ingest(items, none, ["text"])))


def ingest_resume_suffix(spark, d):
    """The second half against what the first half stored: operations bound there replay."""
    items = cut_lineage(_items(spark, d))
    middle = items.count() // 2
    none = items.where("false").select("namespace", "id", F.lit(0).alias("revision"), "text")
    old, new = items.where(F.col("pos") < middle), items.where(F.col("pos") >= middle)
    first = ledger.replay(old, ledger.ingest(old, none, ["text"]))
    stored = old.groupBy("namespace", "id").agg(F.min_by("text", "pos").alias("text")).withColumn("revision", F.lit(1).cast("bigint"))
    bound = first.where("not replayed").join(old.select("namespace", "pos", "fingerprint"), ["namespace", "pos"])
    done = ledger.replay(new, ledger.ingest(new, stored, ["text"]), bound)
    return done.select("operation_id", "pos", "outcome", "revision", "replayed")


def _commands(spark, d):
    e = table(spark, d, "events")
    outcome = F.when(F.col("event_id") % 97 == 0, "retract").when(F.col("event_id") % 2 == 0, "helpful").otherwise("irrelevant")
    commands = e.select(F.col("event_id").alias("pos"), F.lit("events").alias("namespace"), F.concat(F.lit("op:"), F.col("event_id").cast("string")).alias("operation_id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("record_id"), F.lit(1).cast("bigint").alias("expected_revision"), outcome.alias("outcome"))
    records = commands.select("namespace", F.col("record_id").alias("id")).distinct().withColumns({"revision": F.lit(1).cast("bigint"), "status": F.lit("active")})
    return commands, records


def feedback_fold(spark, d):
    return ledger.feedback(*_commands(spark, d)).select("record_id", "pos", "result", "revision")


def feedback_capacity(spark, d):
    commands, records = _commands(spark, d)
    return ledger.simple_feedback(commands, records).groupBy("record_id").agg(F.count_if(F.col("result") == "applied").alias("applied"), F.count_if(F.col("result") == "conflict").alias("conflicts"), F.count_if(F.col("result") == "full").alias("full"))


def expiry_preview(spark, d):
    return ledger.expired(corpus.documents(spark, d), NOW).select("doc_id", "revision")


def expiry_apply(spark, d):
    docs = corpus.documents(spark, d)
    now = docs.select("namespace", "id", (F.col("revision") + (F.col("doc_id") % 3 == 0).cast("bigint")).alias("revision"))
    return ledger.retire(ledger.expired(docs, NOW), now).join(docs.select("id", "doc_id"), "id").select("doc_id", "outcome", "revision")


def canonical_select(spark, d):
    n = F.col("doc_id")
    rows = table(spark, d, "documents").withColumn("id", n.cast("string"))
    scope = F.when(n % 5 == 0, "Unknown ").when(n % 5 == 1, F.lit(None)).when(n % 5 == 2, " team").otherwise("public")
    found = canonical.visible(rows, scope, F.md5("text"), authorize=F.when(n % 4 == 1, F.lit(None)).otherwise(n % 4 != 2), eligible=n % 3 != 0)
    return found.select("doc_id", "source_revision")


def stream_feedback(spark, d):
    """Events as a file stream, repeats of an operation dropped, counted by outcome; written and read again."""
    path = shared_path(spark, "stream")
    table(spark, d, "events").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    rows = stream.select(F.col("ts").cast("timestamp").alias("at"), F.lit("events").alias("namespace"), F.concat_ws(".", "user_id", "event_type", "props").alias("operation_id"), F.col("event_type").alias("outcome"))
    first = ingest.first_operations(rows, "3650 days")
    first.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        record_ids, ingest_fingerprint, derive_records, latest_revision, revision_as_requested, cas_put_outcomes, validate_records, lexical_overlap,
        lexical_rank_topk, token_sets, classify_kinds, redact_secrets, access_filter, exclusion_counts, provenance_evidence, provenance_closure, bm25_topk,
        hybrid_fusion, edge_eligibility, graph_seeds, fanout_topk, graph_expand, recall_full, excerpt_hits, context_pack, jaccard_pairs, consolidation_proposals,
        ingest_batch_outcomes, ingest_checkpoint_replay, ingest_receipts, ingest_resume_suffix, feedback_fold, feedback_capacity, expiry_preview,
        expiry_apply, canonical_select, stream_feedback,
    )
}

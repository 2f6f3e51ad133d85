"""Ledgers: compare-and-swap writes, insert-only ingestion with replays, and feedback."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

FIELDS = ["text", "source", "author", "kind", "trust", "audience", "sources", "derived", "complete", "confidence", "occurred_at", "expires_at", "status"]
CAPACITY = 64


def latest(history: DataFrame) -> DataFrame:
    """The current revision of each record: a hash aggregate, no sort."""
    rest = [c for c in history.columns if c not in ("namespace", "id")]
    return history.groupBy("namespace", "id").agg(F.max_by(F.struct(*rest), "revision").alias("x")).select("namespace", "id", "x.*")


def at_revision(history: DataFrame, asked: DataFrame) -> DataFrame:
    """The exact revisions asked for (namespace, id, revision)."""
    return history.join(asked, ["namespace", "id", "revision"])


def compare_and_swap(writes: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome of writes in order of pos: accepted where expected equals the revision at that moment.

    writes: namespace, id, pos, expected. An accepted write gets the next revision; a refused one reports the
    stored revision. Writes to one record are folded in order.
    """
    queue = writes.groupBy("namespace", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "expected"))).alias("queue"))
    joined = queue.join(current.select("namespace", "id", "revision"), ["namespace", "id"], "left")
    start = F.struct(F.coalesce("revision", F.lit(0).cast("bigint")).alias("now"), F.array().cast("array<struct<pos:bigint,accepted:boolean,revision:bigint>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        ok = w["expected"] == acc["now"]
        now = acc["now"] + ok.cast("bigint")
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(F.struct(w["pos"].cast("bigint").alias("pos"), ok.alias("accepted"), now.alias("revision")))).alias("out"))

    return joined.select("namespace", "id", F.explode(F.aggregate("queue", start, step, lambda a: a["out"])).alias("x")).select("namespace", "id", "x.*")


def meaning(fields: list[str] | None = None) -> Column:
    """A record's content without revision and created_at, for null-safe comparison."""
    return F.struct(*(fields or FIELDS))


def ingest(items: DataFrame, current: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """namespace, id, pos, outcome (inserted, duplicate, conflict) and revision of insert-only items.

    The first item of an id is inserted if nothing is stored; later ones compare with what is then current.
    Stored rows stand before all positions.
    """
    names = fields or FIELDS
    stored = current.select("namespace", "id", meaning(names).alias("held"), F.col("revision").alias("held_revision"))
    first = items.groupBy("namespace", "id").agg(F.min_by(meaning(names), "pos").alias("first"), F.min("pos").alias("first_pos"))
    known = first.join(stored, ["namespace", "id"], "left").select("namespace", "id", "first_pos", F.col("held_revision").isNotNull().alias("was"), F.coalesce("held", "first").alias("held"), F.coalesce("held_revision", F.lit(1)).alias("revision"))
    outcome = F.when(~F.col("was") & (F.col("pos") == F.col("first_pos")), "inserted").when(meaning([f"i.{n}" for n in names]).eqNullSafe(F.col("k.held")), "duplicate").otherwise("conflict")
    return items.alias("i").join(known.alias("k"), ["namespace", "id"]).select("namespace", "id", "i.pos", outcome.alias("outcome"), F.col("k.revision").cast("bigint").alias("revision"))


def replay(items: DataFrame, outcomes: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Checkpointed ingestion: repeated operation ids replay their first outcome.

    items: namespace, operation_id, fingerprint, pos, id. An operation id with another fingerprint cuts the
    batch: rows from that position on are left out. Stored operations (ledger) bind first.
    """
    key = ["namespace", "operation_id"]
    bound = items.groupBy(*key).agg(F.min("pos").alias("bound_pos"), F.min_by("fingerprint", "pos").alias("bound"))
    if ledger is not None:
        old = ledger.select(*key, F.col("fingerprint").alias("old"), F.col("outcome").alias("old_outcome"), F.col("revision").alias("old_revision"))
        bound = bound.join(old, key, "left").withColumn("bound", F.coalesce("old", "bound")).withColumn("bound_pos", F.when(F.col("old").isNotNull(), -1).otherwise(F.col("bound_pos")))
    else:
        bound = bound.withColumns({"old_outcome": F.lit(None).cast("string"), "old_revision": F.lit(None).cast("bigint")})
    joined = items.join(bound, key)
    cut = joined.where(F.col("fingerprint") != F.col("bound")).groupBy("namespace").agg(F.min("pos").alias("cut"))
    kept = joined.join(F.broadcast(cut), "namespace", "left").where(F.col("cut").isNull() | (F.col("pos") < F.col("cut")))
    first = outcomes.select("namespace", F.col("pos").alias("bound_pos"), "outcome", "revision")
    return kept.join(first, ["namespace", "bound_pos"], "left").select(
        "namespace", "operation_id", "pos", F.coalesce("old_outcome", "outcome").alias("outcome"), F.coalesce("old_revision", "revision").alias("revision"), (F.col("pos") > F.col("bound_pos")).alias("replayed")
    )


def receipt_lines(operations: DataFrame) -> DataFrame:
    """namespace, pos, operation_id and what became of each item: inserted, duplicates or conflicts; order by pos."""
    kind = F.when(F.col("outcome") == "conflict", "conflicts").when(F.col("replayed") | (F.col("outcome") == "duplicate"), "duplicates").otherwise("inserted")
    return operations.select("namespace", "pos", "operation_id", kind.alias("kind"))


def receipts(operations: DataFrame) -> DataFrame:
    """One row per namespace: how many were inserted, duplicates and conflicts, and the cursor's advance."""
    lines = receipt_lines(operations)
    return lines.groupBy("namespace").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("inserted", "duplicates", "conflicts")), F.count(F.lit(1)).alias("cursor"))


OUTCOMES = ["helpful", "irrelevant", "incorrect", "retract"]
_RECEIPT = "namespace string, record_id string, pos long, operation_id string, outcome string, result string, revision long, duplicate boolean"


def feedback(commands: DataFrame, records: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Result of feedback commands in order of pos.

    Commands are folded in order: replay, conflict (id bound to another command or record, or another revision),
    inactive, full, applied. Failed commands bind nothing. A record's commands are folded together; in namespaces
    that use one operation id for several records, all commands of the namespace are. An unknown outcome or a bad
    operation id fails the whole call. log: commands applied before (namespace, record_id, operation_id,
    expected_revision, outcome, revision), which bind first and count towards the capacity.
    """
    name = F.when(F.col("operation_id").rlike(r"\A[A-Za-z0-9_.:-]{1,100}\z"), F.col("operation_id")).otherwise(F.raise_error(F.lit("operation_id: not an identifier")).cast("string"))
    known = F.when(F.col("outcome").isin(OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.lit("outcome: unknown")).cast("string"))
    key = ["namespace", "record_id", "operation_id", "expected_revision", "outcome"]
    rows = commands.select(*key, "pos", F.lit(None).cast("bigint").alias("bound")).withColumns({"operation_id": name, "outcome": known})
    if log is not None:
        rows = rows.unionByName(log.select(*key, F.lit(-1).cast("bigint").alias("pos"), F.col("revision").alias("bound")))
    state = records.select("namespace", F.col("id").alias("record_id"), "revision", "status")
    shared = spread_operations(rows).select("namespace").distinct().withColumn("wide", F.lit(True))
    rows = rows.join(state, ["namespace", "record_id"], "left").join(shared, "namespace", "left")
    rows = rows.withColumn("fold", F.when(F.col("wide"), "").otherwise(F.col("record_id")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        now: dict = {}
        bound: dict = {}
        out = []
        for r in pdf.sort_values("pos", kind="stable").itertuples():
            if r.record_id not in now:
                now[r.record_id] = [None if pd.isna(r.revision) else int(r.revision), r.status == "active", 0]
            own, command = now[r.record_id], (r.record_id, r.expected_revision, r.outcome)
            if not pd.isna(r.bound):  # applied in an earlier call
                bound[r.operation_id] = (command, int(r.bound))
                own[2] += r.outcome in ("helpful", "irrelevant")
                continue
            result, at, again = "applied", None, False
            if r.operation_id in bound:
                held, first = bound[r.operation_id]
                result, at, again = ("applied", first, True) if held == command else ("conflict", None, False)
            elif own[0] is None or r.expected_revision != own[0]:
                result = "conflict"
            elif not own[1]:
                result = "inactive"
            elif r.outcome in ("helpful", "irrelevant") and own[2] >= CAPACITY:
                result = "full"
            else:
                if r.outcome in ("incorrect", "retract"):
                    own[0], own[1] = own[0] + 1, False
                else:
                    own[2] += 1
                at = own[0]
                bound[r.operation_id] = (command, at)
            out.append((r.namespace, r.record_id, r.pos, r.operation_id, r.outcome, result, at, again))
        found = pd.DataFrame(out, columns=[x.split()[0] for x in _RECEIPT.split(", ")])
        return found.astype({"revision": "Int64"})

    return rows.groupBy("namespace", "fold").applyInPandas(fold, _RECEIPT)


def simple_feedback(commands: DataFrame, records: DataFrame) -> DataFrame:
    """The same where operation ids are unique and every command names the current revision: windows only."""
    order = Window.partitionBy("namespace", "record_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    terminal = F.col("outcome").isin("incorrect", "retract")
    before = commands.withColumns({"ended": F.coalesce(F.max(terminal).over(order), F.lit(False)), "seen": F.coalesce(F.sum((~terminal).cast("int")).over(order), F.lit(0))})
    rows = before.join(records.select("namespace", F.col("id").alias("record_id"), "revision"), ["namespace", "record_id"])
    result = F.when(F.col("ended"), "conflict").when(~terminal & (F.col("seen") >= CAPACITY), "full").otherwise("applied")
    return rows.select("namespace", "record_id", "pos", "operation_id", "outcome", result.alias("result"), F.when(result == "applied", F.col("revision") + terminal.cast("bigint")).alias("revision"))


def spread_operations(commands: DataFrame) -> DataFrame:
    """Operation ids used for more than one record."""
    return commands.groupBy("namespace", "operation_id").agg(F.countDistinct("record_id").alias("n")).where("n > 1")


def expired(records: DataFrame, now: float) -> DataFrame:
    """Active records whose time is up."""
    return records.where((F.col("status") == "active") & (F.lit(now) >= F.col("expires_at")))


def retire(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome of retiring candidates by compare-and-swap: applied with the next revision, or conflicted."""
    stored = current.select("namespace", "id", F.col("revision").alias("stored"))
    ok = F.col("revision") == F.col("stored")
    return candidates.join(stored, ["namespace", "id"]).select("namespace", "id", F.when(ok, "applied").otherwise("conflicted").alias("outcome"), F.when(ok, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"))

"""A store of revisions: append-only Parquet batches, visible once a manifest names them.

Writers take a version by creating its manifest file exclusively through the
file system that Spark uses for the path; who comes second loads the newer
state and tries again. Readers see the batches of manifests only, so that a
failed write leaves nothing behind. History is never rewritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from recordloom.errors import CheckpointConflictError, ConflictError, OperationConflictError, identifier
from recordloom.functions import text as tx
from recordloom.operators import ledger, provenance
from recordloom.schema import EDGE, FEEDBACK, OPERATION, RECORD, checked
from recordloom.session import cut_lineage

VERSION = 2


class Store:
    def __init__(self, spark: SparkSession, path: str, retries: int = 20):
        self.spark, self.path, self.retries = spark, path.rstrip("/"), retries
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self.fs.exists(self._path(f"{self.path}/manifests")):
            self.fs.mkdirs(self._path(f"{self.path}/manifests"))
            self._create(f"{self.path}/meta.json", json.dumps({"version": VERSION}))
        if (found := json.loads(self._text(f"{self.path}/meta.json"))["version"]) > VERSION:
            raise ValueError(f"unsupported store version {found}")

    def _create(self, path: str, text: str) -> bool:
        """Creates a file that must not exist yet; false if it does."""
        try:
            out = self.fs.create(self._path(path), False)
        except Exception:
            if self.fs.exists(self._path(path)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, path: str) -> str:
        """A small file's text, read through the file system: no Spark job."""
        stream = self.fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifests(self) -> list[dict]:
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/manifests")) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._text(f"{self.path}/manifests/{n}")) for n in names]

    def _read(self, table: str, schema, at: list[dict]) -> DataFrame:
        paths = [m["tables"][table] for m in at if table in m["tables"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in paths))

    def _commit(self, number: int, tables: dict[str, DataFrame], cursors: dict | None = None) -> bool:
        names = {}
        for name, df in tables.items():
            names[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{names[name]}")
        return self._create(f"{self.path}/manifests/{number:012d}.json", json.dumps({"tables": names, "cursors": cursors or {}}))

    def history(self, namespace: str = "default") -> DataFrame:
        return checked(self._read("history", RECORD, self._manifests()).where(F.col("namespace") == namespace))

    def all_history(self) -> DataFrame:
        """The history of all namespaces."""
        return checked(self._read("history", RECORD, self._manifests()))

    def snapshot(self, namespace: str = "default") -> DataFrame:
        return ledger.latest(self.history(namespace))

    def get(self, record_id: str, namespace: str = "default", revision: int | None = None) -> DataFrame:
        rows = self.history(namespace).where(F.col("id") == record_id)
        return ledger.latest(rows) if revision is None else rows.where(F.col("revision") == revision)

    def put(self, records: DataFrame, expected: str = "revision") -> DataFrame:
        """Writes records (one per id) whose column `expected` equals the stored revision; all or none."""
        rows = records.select(*(F.col(f.name).cast(f.dataType) for f in RECORD.fields), F.col(expected).cast("bigint").alias("__expected"))
        if not rows.groupBy("namespace", "id").count().where("count > 1").isEmpty():
            raise ConflictError("an id occurs twice in one call")
        for _ in range(self.retries):
            at = self._manifests()
            current = ledger.latest(self._read("history", RECORD, at)).select("namespace", "id", F.col("revision").alias("__stored"))
            joined = rows.join(current, ["namespace", "id"], "left").withColumn("__stored", F.coalesce("__stored", F.lit(0)))
            if not joined.where("__expected <> __stored").isEmpty():
                raise ConflictError("a record's expected revision is not the stored one")
            new = checked(joined.withColumn("revision", F.col("__stored") + 1).select(*RECORD.names))
            if self._commit(len(at), {"history": new}):
                return self.spark.read.schema(RECORD).parquet(f"{self.path}/{self._manifests()[len(at)]['tables']['history']}")
        raise ConflictError("the store is busy")

    def link(self, edges: DataFrame) -> None:
        """Adds edges backed by current revisions; the last write of an edge holds."""
        rows = edges.select(*(F.col(f.name).cast(f.dataType) for f in EDGE.fields))
        rows = rows.withColumns({"source": tx.casefold(F.col("source")), "target": tx.casefold(F.col("target"))})
        bad = (F.trim("source") == "") | (F.trim("relation") == "") | (F.trim("target") == "") | ~F.coalesce((F.col("weight") > 0) & (F.col("weight") <= 1), F.lit(False))
        if not rows.where(bad).isEmpty():
            raise ValueError("non-empty concepts and a weight in (0, 1] are required")
        for _ in range(self.retries):
            at = self._manifests()
            current = ledger.latest(self._read("history", RECORD, at)).select("namespace", F.col("id").alias("record_id"), "revision")
            if not rows.join(current, ["namespace", "record_id", "revision"], "left_anti").isEmpty():
                raise ConflictError("a link needs the current record")
            if self._commit(len(at), {"edges": rows.withColumn("batch", F.lit(len(at)))}):
                return
        raise ConflictError("the store is busy")

    def edges(self, namespace: str = "default") -> DataFrame:
        rows = self._read("edges", StructType([*EDGE.fields, StructField("batch", IntegerType())]), self._manifests()).where(F.col("namespace") == namespace)
        key = ["namespace", "source", "relation", "target", "record_id"]
        return rows.groupBy(*key).agg(F.max_by(F.struct("revision", "weight"), "batch").alias("x")).select(*key, "x.*")

    def cursor(self, name: str, namespace: str = "default") -> int:
        found = [m["cursors"][f"{namespace}\x00{name}"] for m in self._manifests() if f"{namespace}\x00{name}" in m["cursors"]]
        return found[-1] if found else 0

    def operations(self, namespace: str = "default") -> DataFrame:
        return self._read("operations", OPERATION, self._manifests()).where(F.col("namespace") == namespace)

    def ingest(self, items: DataFrame, name: str, cursor: int, namespace: str = "default") -> DataFrame:
        """Checkpointed ingestion of items (pos from `cursor` on, operation_id, fingerprint and a record's fields).

        Records, operations and the cursor become visible together. Items before an operation id that is bound
        to other input are kept, then OperationConflictError is raised.
        """
        identifier(name, "name")
        at = self._manifests()
        if self.cursor(name, namespace) != cursor:
            raise CheckpointConflictError("the source cursor has moved")
        items = items.where(F.col("pos") >= cursor)
        stored = ledger.latest(self._read("history", RECORD, at).where(F.col("namespace") == namespace))
        old = self._read("operations", OPERATION, at).where(F.col("namespace") == namespace)
        fresh = items.join(old.select("namespace", "operation_id"), ["namespace", "operation_id"], "left_anti")
        firsts = fresh.join(fresh.groupBy("namespace", "operation_id").agg(F.min("pos").alias("pos")), ["namespace", "operation_id", "pos"])
        outcomes = ledger.ingest(firsts, stored)
        done = ledger.replay(items.select("namespace", "operation_id", "fingerprint", "pos", "id"), outcomes, old).join(items.select("namespace", "pos", "id", "fingerprint"), ["namespace", "pos"])
        new = done.where(~F.col("replayed"))
        records = items.join(new.where("outcome = 'inserted'").select("namespace", "pos"), ["namespace", "pos"]).withColumn("revision", F.lit(1).cast("bigint"))
        total, kept = items.count(), done.count()
        tables = {"history": checked(records.select(*RECORD.names)), "operations": new.select("namespace", "operation_id", "fingerprint", F.col("id").alias("record_id"), "outcome", "revision")}
        if not self._commit(len(at), tables, {f"{namespace}\x00{name}": cursor + kept}):
            raise CheckpointConflictError("the source cursor has moved")
        if kept < total:
            raise OperationConflictError("an operation id is bound to other input")
        return done

    def retire(self, candidates: DataFrame) -> DataFrame:
        """Retires candidates (namespace, id, revision) that are still current. Others are reported as conflicted and left."""
        wanted = candidates.select("namespace", "id", "revision")
        for _ in range(self.retries):
            at = self._manifests()
            current = ledger.latest(self._read("history", RECORD, at))
            outcome = ledger.retire(wanted, current)
            done = outcome.where("outcome = 'applied'").select("namespace", "id", F.col("revision").alias("next"))
            new = current.join(done, ["namespace", "id"]).withColumns({"revision": F.col("next"), "status": F.lit("retired")})
            outcome = cut_lineage(outcome)
            if self._commit(len(at), {"history": checked(new.select(*RECORD.names))}):
                return outcome
        raise ConflictError("the store is busy")

    def maintain(self, now: float, namespace: str = "default", dry_run: bool = True) -> DataFrame:
        """Expired records; unless dry_run they are retired by a new revision: id, outcome and revision of each."""
        rows = ledger.expired(self.snapshot(namespace), now)
        if dry_run:
            return rows.select("id", "revision")
        return self.retire(cut_lineage(rows.select("namespace", "id", "revision"))).select("id", "outcome", "revision")

    def feedback(self, commands: DataFrame) -> DataFrame:
        """Applies feedback commands (pos, namespace, operation_id, record_id, expected_revision, outcome) for good.

        Operation ids are bound within their namespace, over all calls. Applied commands and the retirements they
        cause become visible together.
        """
        for _ in range(self.retries):
            at = self._manifests()
            current = ledger.latest(self._read("history", RECORD, at))
            done = cut_lineage(ledger.feedback(commands, current, self._read("feedback", FEEDBACK, at)))
            fresh = done.where("result = 'applied' and not duplicate").join(commands.select("namespace", "pos", "expected_revision"), ["namespace", "pos"])
            ended = fresh.where(F.col("outcome").isin("incorrect", "retract")).select("namespace", F.col("record_id").alias("id"), F.col("revision").alias("next"))
            new = current.join(ended, ["namespace", "id"]).withColumns({"revision": F.col("next"), "status": F.lit("retired")})
            tables = {"feedback": fresh.select(*FEEDBACK.names), "history": checked(new.select(*RECORD.names))}
            if self._commit(len(at), tables):
                return done
        raise ConflictError("the store is busy")

    def evidence(self, now: float, namespace: str = "default", **bounds) -> DataFrame:
        return provenance.resolve(self.snapshot(namespace), now, **bounds)

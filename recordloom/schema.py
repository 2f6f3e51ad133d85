"""Schemas of records, edges and ledgers, and the check that names a record's first bad field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_REF = T.StructType([T.StructField("id", T.StringType()), T.StructField("revision", T.LongType())])
_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "strings": T.ArrayType(T.StringType()), "refs": T.ArrayType(_REF)}


def table_of(fields: str) -> T.StructType:
    """A schema from "name kind, name kind"; made without a session, unlike DDL strings."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in fields.split(", "))])


RECORD = table_of(
    "namespace string, id string, revision bigint, text string, source string, author string, kind string, trust string, audience strings, sources refs, "
    "derived boolean, complete boolean, confidence double, created_at double, occurred_at double, expires_at double, status string"
)
EDGE = table_of("namespace string, source string, relation string, target string, record_id string, revision bigint, weight double")
OPERATION = table_of("namespace string, operation_id string, fingerprint string, record_id string, outcome string, revision bigint")

FEEDBACK = table_of("namespace string, record_id string, operation_id string, expected_revision bigint, outcome string, revision bigint")

TRUST = ["untrusted", "unknown", "trusted"]
STATUS = ["active", "retired"]


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def _not_finite(name: str, nullable: bool) -> Column:
    bad = F.isnan(name) | (F.abs(name) == float("inf"))
    return F.coalesce(bad, F.lit(not nullable))


def first_bad_field() -> Column:
    """Name of the first field of a record that breaks the rules, or null."""
    checks = [
        ("id", _blank("id")),
        ("namespace", _blank("namespace")),
        ("text", F.col("text").isNull()),
        ("complete", F.col("complete").isNull() | F.col("derived").isNull()),
        ("source", _blank("source")),
        ("kind", _blank("kind")),
        ("trust", ~F.coalesce(F.col("trust").isin(TRUST), F.lit(False))),
        ("status", ~F.coalesce(F.col("status").isin(STATUS), F.lit(False))),
        ("confidence", _not_finite("confidence", False) | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        ("created_at", _not_finite("created_at", False)),
        ("occurred_at", _not_finite("occurred_at", True)),
        ("expires_at", _not_finite("expires_at", True)),
        ("audience", F.col("audience").isNull() | F.exists("audience", lambda a: a.isNull() | (F.trim(a) == "")) | (F.array_contains("audience", "*") & (F.size(F.array_distinct("audience")) > 1))),
        ("sources", F.col("sources").isNull() | F.exists("sources", lambda s: s["id"].isNull() | (s["id"] == "") | s["revision"].isNull() | (s["revision"] < 1))),
        ("revision", F.col("revision").isNull() | (F.col("revision") < 0)),
    ]
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


def checked(records: DataFrame) -> DataFrame:
    """The records, audiences sorted and distinct; reading a bad row fails the whole read and names its id and field only."""
    bad = first_bad_field()
    error = F.raise_error(F.concat(F.lit("record "), F.coalesce("id", F.lit("?")), F.lit(": invalid field "), bad))
    kept = records.withColumn("id", F.when(bad.isNotNull(), error.cast("string")).otherwise(F.col("id")))
    return kept.withColumn("audience", F.array_sort(F.array_distinct("audience")))


def to_json(records: DataFrame) -> DataFrame:
    """One JSON object a record, with all fields of a record, nulls included (column json)."""
    return records.select(F.to_json(F.struct(*RECORD.names), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Records of JSON objects (column json). Unknown fields are ignored; a bad field fails the read as in `checked`."""
    return checked(rows.select(F.from_json("json", RECORD).alias("r")).select("r.*"))

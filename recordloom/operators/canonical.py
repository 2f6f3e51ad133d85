"""Read seam to a host's own rows: checks, authorisation and a bounded selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.errors import SnapshotError, whole

UNSET = ["unknown", "unspecified"]


def select(rows: DataFrame, audience: str, scope: Column, revision: Column, authorize: Column, eligible: Column, limit: int = 20, order: Column | None = None) -> tuple[DataFrame, bool]:
    """Authorised rows with their revision, at most `limit`, and whether there are more.

    Only a true authorisation or eligibility counts. A missing or repeated id fails the whole snapshot.
    """
    if not isinstance(audience, str) or not audience.strip():
        raise ValueError("an explicit authenticated audience is required")
    whole(limit, "limit", 1, 1000)
    check = rows.agg(F.count_if(F.col("id").isNull() | (F.trim("id") == "")).alias("blank"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("repeats")).first()
    if check["blank"]:
        raise SnapshotError("missing record id")
    if check["repeats"]:
        raise SnapshotError("repeated id in the snapshot")
    fit = visible(rows, scope, revision, authorize, eligible)
    first = fit.orderBy(F.col("id") if order is None else order).limit(limit + 1)
    return first.limit(limit), first.count() > limit


def visible(rows: DataFrame, scope: Column, revision: Column, authorize: Column, eligible: Column) -> DataFrame:
    true = lambda c: c.eqNullSafe(F.lit(True))
    known = F.coalesce((F.trim(scope) != "") & ~F.lower(F.trim(scope)).isin(UNSET), F.lit(False))
    fit = rows.where(true(eligible) & F.coalesce(F.trim("text") != "", F.lit(False)) & known)
    blank = revision.isNull() | (F.trim(revision) == "")
    named = F.when(blank, F.raise_error(F.lit("missing revision")).cast("string")).otherwise(revision)
    return fit.withColumn("source_revision", named).where(true(authorize))

"""Identities of records: byte-exact JSON, hashed natively."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Protocol tags (fixed values: stored identities depend on them).
DERIVED_TAG = "recordloom-derived-v1"
INGEST_TAG = "recordloom-ingest-v1"

_UPPER_ESCAPES = ["0B", "0E", "0F", *(f"1{c}" for c in "ABCDEF")]


def json_text(value: Column) -> Column:
    """A JSON string literal; null gives the word null. Control characters are written in lower-case hex."""
    out = F.to_json(F.array(value))
    out = out.substr(F.lit(2), F.length(out) - 2)
    lowered = out
    for code in _UPPER_ESCAPES:
        lowered = F.regexp_replace(lowered, rf"((?<!\\)(?:\\\\)*\\u00){code}", f"$1{code.lower()}")
    out = F.when(out.rlike(r"\\u00(0[BEF]|1[A-F])"), lowered).otherwise(out)
    return F.coalesce(out, F.lit("null"))


def ascii_text(value: Column) -> Column:
    """A JSON string with every non-ASCII character as \\uXXXX (pairs beyond the first plane)."""
    unit = lambda code: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(code < 127, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    plain = json_text(value)
    return F.when(plain.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(F.split(plain, ""), one), "")).otherwise(plain)


def record_id(namespace: Column, source: Column, anchor: Column, text: Column) -> Column:
    """Identity of a primary record."""
    parts = [json_text(x) for x in (namespace, source, anchor, text)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256)


def derived_id(namespace: Column, source: Column, anchor: Column, text: Column, sources: Column) -> Column:
    """Identity of a derived record: distinct parents in order, so that order and repeats don't matter."""
    pairs = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.struct(s["id"].alias("id"), s["revision"].alias("revision")))))
    parents = F.array_join(F.transform(pairs, lambda s: F.concat(F.lit("["), json_text(s["id"]), F.lit(","), s["revision"].cast("string"), F.lit("]"))), ",")
    body = F.concat(
        F.lit('{"anchor":'), json_text(anchor), F.lit(',"namespace":'), json_text(namespace), F.lit(',"parents":['), parents,
        F.lit(f'],"schema":"{DERIVED_TAG}","source":'), json_text(source), F.lit(',"text":'), json_text(text), F.lit("}"),
    )
    return F.sha2(body, 256)


@F.pandas_udf(T.StringType())
def _ratio(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None or x != x else "[{},{}]".format(*float(x).as_integer_ratio()))


def rational(value: Column) -> Column:
    """A double as [numerator,denominator]; null gives the word null. Whole numbers stay native."""
    whole = (value == F.floor(value)) & (F.abs(value) < float(1 << 62))
    text = F.when(whole, F.concat(F.lit("["), value.cast("bigint").cast("string"), F.lit(",1]"))).otherwise(_ratio(value))
    return F.coalesce(text, F.lit("null"))


def fingerprint(r: dict[str, Column], integral: bool = False) -> Column:
    """Hash of a record's meaning: all fields but revision and created_at. integral: numbers are known to be whole."""
    number = (lambda x: F.coalesce(F.concat(F.lit("["), x.cast("bigint").cast("string"), F.lit(",1]")), F.lit("null"))) if integral else rational
    flag = lambda x: F.when(x, "true").otherwise("false")
    audience = F.array_join(F.transform(r["audience"], ascii_text), ",")
    sources = F.array_join(F.transform(r["sources"], lambda s: F.concat(F.lit('{"id":'), ascii_text(s["id"]), F.lit(',"revision":'), s["revision"].cast("string"), F.lit("}"))), ",")
    fields = [
        ("audience", F.concat(F.lit("["), audience, F.lit("]"))), ("author", ascii_text(r["author"])), ("complete", flag(r["complete"])),
        ("confidence", number(r["confidence"])), ("derived", flag(r["derived"])), ("expires_at", number(r["expires_at"])), ("id", ascii_text(r["id"])),
        ("kind", ascii_text(r["kind"])), ("namespace", ascii_text(r["namespace"])), ("occurred_at", number(r["occurred_at"])),
        ("source", ascii_text(r["source"])), ("sources", F.concat(F.lit("["), sources, F.lit("]"))), ("status", ascii_text(r["status"])),
        ("text", ascii_text(r["text"])), ("trust", ascii_text(r["trust"])),
    ]
    body = F.concat(*(x for i, (name, value) in enumerate(fields) for x in (F.lit(f'{"," if i else ""}"{name}":'), value)))
    return F.sha2(F.concat(F.lit('{"record":{'), body, F.lit(f'}},"schema":"{INGEST_TAG}"}}')), 256)

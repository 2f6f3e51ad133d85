"""Secret scans with DataFrame functions only.

Fixed patterns (assigned passwords and tokens, access keys, long hex runs), and
a sliding window of Shannon entropy over candidate strings for each character
class. The window's entropy is kept by incremental counts: a step adds one
character and drops one. Counts lie in a few long integers, five bits for each
character of the class, and a step changes two of them; the sum of c * log2(c)
changes by the difference of two table entries each, in integers, so that
results don't depend on the order of floating-point sums.

What the patterns found and what the allow-list names (UUIDs, placeholders,
paths, repeated characters) is blanked before candidates are taken, so that a
secret beside it is still seen. A candidate that is made of words or of digits
alone is left out. Windows that overlap make one span, others spans of their own.

Spans come from two regular-expression calls a pattern: all matches, and the
text between them, whose lengths give the places.

Defined cases: null counts as empty; repeated rows get the same result; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
MIN_ASSIGN, MIN_ACCESS = 12, 18

WINDOW = 20
_RUN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_RUN}])[{_RUN}]{{{WINDOW},}}"
#: Character classes: alphabet (lower case stands for both in hex) and least entropy in bits of a window.
CLASSES = {
    "entropy_hex": ("0123456789abcdef", 3.1),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 3.8),
}
#: Never part of a secret (fixed patterns); they are blanked.
ALLOWED = (
    r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])"
    r"|(?i:example|placeholder|changeme|your[_-]|xxxx)|/[A-Za-z_-]+/[A-Za-z_-]+/|([A-Za-z0-9+/_=-])\1{5,}"
)
#: Parts of ordinary names; a candidate that is nearly all made of them is no secret.
WORDS, LEAST_REST = r"[A-Z][a-z]{2,}|[a-z]{3,}|[A-Z]{3,}|(?<![0-9])[0-9]{1,4}(?![0-9])|[^A-Za-z0-9]+", 4
_SCALE = 1 << 20
_TABLE = [round(c * math.log2(c) * _SCALE) if c else 0 for c in range(WINDOW + 1)]
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the matches whose group has at least `least` characters."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(found, F.length)
    parts = F.zip_with(F.slice(between, 1, F.size(found)), F.zip_with(found, sizes, lambda m, n: F.struct(F.length(m).alias("length"), n.alias("size"))), lambda gap, m: F.struct(F.length(gap).alias("gap"), m["length"].alias("length"), m["size"].alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["length"]
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["size"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with its spans (sorted by start) replaced by blanks."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        kept = F.substring(text, acc["at"] + 1, begin - acc["at"])
        return F.struct(end.alias("at"), F.concat(acc["out"], kept, F.repeat(F.lit(" "), end - begin)).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _without_allowed(text: Column) -> Column:
    """The text with what the allow-list names replaced by blanks."""
    found, between = F.regexp_extract_all(text, F.lit(ALLOWED), F.lit(0)), F.split(text, ALLOWED, -1)
    blanks = F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m)))
    joined = F.array_join(F.zip_with(between, F.concat(blanks, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def _ordinary(candidate: Column) -> Column:
    """Whether a candidate is made of words, or of digits and signs."""
    return candidate.rlike("^[0-9_=-]+$") | (F.length(F.regexp_replace(candidate, WORDS, "")) * LEAST_REST < F.length(candidate))


_BITS, _PER_LONG = 5, 12


def window_spans(candidate: Column, alphabet: str, least: float, fold: bool) -> Column:
    """Starts and ends (from 0) of the unions of overlapping windows with at least `least` bits.

    A window with a character outside the alphabet doesn't count.
    """
    longs = len(alphabet) // _PER_LONG + 1  # character 0 is any other
    most = math.floor((math.log2(WINDOW) - least) * WINDOW * _SCALE)
    table = F.array(*(F.lit(x) for x in _TABLE))
    places = F.transform(F.split(F.lower(candidate) if fold else candidate, ""), lambda c: F.instr(F.lit(alphabet), c))
    entry = lambda c: F.element_at(table, (c + 1).cast("int"))
    names = [f"c{k}" for k in range(longs)]
    pairs = "array<struct<lo:int,hi:int>>"
    none = F.array().cast(pairs)
    start = F.struct(*(F.lit(0).cast("bigint").alias(x) for x in names), F.lit(0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), none.alias("out"))
    close = lambda acc: F.when(acc["lo"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))))).otherwise(acc["out"])

    def run(place: Column) -> Column:
        def step(acc: Column, new: Column) -> Column:
            at = acc["at"] + 1
            old = F.when(at > WINDOW, F.element_at(place, F.greatest(F.lit(1), at - WINDOW))).otherwise(-1)
            held = lambda c: F.call_function("shiftright", F.element_at(F.array(*(acc[x] for x in names)), F.greatest(F.lit(0), F.floor(c / _PER_LONG)).cast("int") + 1), _shift(c)).bitwiseAND(F.lit(31))
            unit = lambda c, k: F.when(F.floor(c / _PER_LONG) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), _shift(c))).otherwise(0)
            counts = [(acc[x] + unit(new, k) - unit(old, k)).alias(x) for k, x in enumerate(names)]
            was_new, was_old = held(new), held(old)
            change = F.when(old == new, 0).otherwise(entry(was_new + 1) - entry(was_new) + F.when(old >= 0, entry(was_old - 1) - entry(was_old)).otherwise(0))
            total = acc["sum"] + change
            others = (acc["c0"] + unit(new, 0) - unit(old, 0)).bitwiseAND(F.lit(31))
            good = (at >= WINDOW) & (total <= most) & (others == 0)
            apart = good & (at - WINDOW >= acc["hi"])
            return F.struct(
                *counts, total.alias("sum"), at.alias("at"), F.when(apart, at - WINDOW).otherwise(acc["lo"]).alias("lo"),
                F.when(good, at).otherwise(acc["hi"]).alias("hi"), F.when(apart, close(acc)).otherwise(acc["out"]).alias("out"),
            )

        return F.aggregate(place, start, step, close)

    return F.element_at(F.transform(F.array(places), run), 1)


def _shift(place: Column) -> Column:
    return (F.pmod(place, F.lit(_PER_LONG)) * _BITS).cast("int")


def _entropy(text: Column, candidates: Column, kind: str) -> Column:
    alphabet, least = CLASSES[kind]
    number = F.lit(KINDS.index(kind))
    looked = F.transform(candidates, lambda c: F.transform(window_spans(F.substring(text, c["start"] + 1, c["end"] - c["start"]), alphabet, least, kind == "entropy_hex"), lambda w: F.struct((c["start"] + w["lo"]).alias("start"), number.alias("kind"), (c["start"] + w["hi"]).alias("end"))))
    return F.flatten(looked)


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the fixed patterns, base_sha256 and spans of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.array_sort(F.concat(_spans(F.col("text"), ASSIGN, 0, 2, MIN_ASSIGN), _spans(F.col("text"), ACCESS, 1, 0, MIN_ACCESS), _spans(F.col("text"), HEX, 2)))
    found = rows.select("doc_id", "text", base.alias("base"))
    none = F.array().cast(_SPAN)
    clear = _without_allowed(_blanked(F.col("text"), F.col("base")))
    found = found.select("doc_id", "text", "base", F.when(F.col("text").rlike(CANDIDATE), clear).alias("clear"))
    found = found.select("doc_id", "text", "base", F.when(F.col("clear").isNotNull(), _spans(F.col("clear"), CANDIDATE, 0)).otherwise(none).alias("runs"))
    candidates = F.filter("runs", lambda c: ~_ordinary(F.substring(F.col("text"), c["start"] + 1, c["end"] - c["start"])))
    found = found.select("doc_id", "text", "base", candidates.alias("runs"))
    extra = F.when(F.size("runs") > 0, F.concat(*(_entropy(F.col("text"), F.col("runs"), k) for k in CLASSES))).otherwise(none)
    found = found.select("doc_id", "base", F.array_sort(F.concat(F.col("base"), extra)).alias("spans"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def op4(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

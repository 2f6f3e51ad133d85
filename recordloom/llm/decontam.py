"""Benchmark decontamination by template canonicalisation.

Words lose case and outer signs, and numbers, units after numbers and names
(capitalised words inside a sentence) become typed placeholders. Case and place
may hide a name or feign one, so a window with names also stands with these as
literal words, and a window with a capitalised start of a sentence also with
that as a name; two windows match if any of their forms do. Runs of
WINDOW template words of the benchmark are hash-joined to those of all
documents. In a window the slots must be consistent: each number, unit or name
of the item stands for one value in the document. So the verbatim question is
found, and so is one with other numbers and names, but not chance agreement. A
window that conflicts is left out alone: one value may play independent roles in
an item, and its other windows still count. A document is contaminated by an
item of which consistent windows cover at least COVERAGE.

The documents' windows are first tried against a bitmap of the benchmark's, of
fixed size, and only those that hit it are joined; false hits go in the join.

Defined cases: null texts count as empty; an item of fewer than WINDOW words is
one window of its own length, of fewer than MIN_WORDS words it is not looked
for; windows with fewer than half literal words are left out, unless that
leaves an item without any; repeated rows get the same result; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import materialise, release, strings

U = np.uint64
WINDOW, MIN_WORDS, COVERAGE = 8, 4, 0.5
BITS = 1 << 23
_NUMBER, _NAME, _UNIT = (U(x) for x in (0x6E756D626572, 0x6E616D65, 0x756E6974))
#: Units that a number may carry (fixed values).
UNITS = """
mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound
pounds oz ounce ounces ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour
hours day days week weeks month months year years percent % dollar dollars euro euros cent cents usd eur km/h mph
degrees degree
""".split()
_UNIT_HASHES = None


def _unit_hashes() -> np.ndarray:
    global _UNIT_HASHES
    if _UNIT_HASHES is None:
        b = words.batch(UNITS)
        _UNIT_HASHES = np.sort(b.hashes)
    return _UNIT_HASHES


class Template:
    """Template words of some texts: hash, type (0 literal, 1 number, 2 name, 3 unit), bounds and text.

    Form 0 has names inside sentences as placeholders, form 1 none, form 2 those that begin a sentence too.
    """

    def __init__(self, texts: list[str]):
        b = words.batch(texts, hashed=False)
        self.low, kinds = words.fold(b.codes)
        start, end = words.cores(b, kinds)
        some = end > start
        start, end, owner = start[some], end[some], b.owner[some]
        last_sign = b.codes[b.ends[some] - 1]
        upto = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        digits, letters, upper = upto(kinds == 3), upto((kinds == 1) | (kinds == 2)), upto(kinds == 1)
        count = lambda c: c[end] - c[start]
        n_digits, n_letters = count(digits), count(letters)
        h = words.span_hashes(self.low, start, end)
        number = (n_digits > 0) & (kinds[start] == 3) & (n_letters <= 3)
        fresh = np.ones(len(start), bool)  # first of a text, a line or a sentence
        if len(start) > 1:
            breaks = upto(b.codes == 10)
            stops = np.isin(last_sign[:-1], [33, 46, 58, 63])
            fresh[1:] = (owner[1:] != owner[:-1]) | stops | (breaks[start[1:]] > breaks[end[:-1]])
        capital = ~number & (kinds[start] == 1) & (count(upper) == 1) & (n_letters > 1)
        unit = np.zeros(len(start), bool)
        unit[1:] = number[:-1] & (owner[1:] == owner[:-1]) & np.isin(h[1:], _unit_hashes())
        fixed = np.where(number, 1, np.where(unit, 3, 0))
        self.kinds, self.hashes = [], []
        for name in (capital & ~fresh, np.zeros(len(start), bool), capital):
            self.kinds.append(np.where(fixed > 0, fixed, np.where(name, 2, 0)))
            self.hashes.append(np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h))))
        self.differs = [None, *(upto(k != self.kinds[0]) for k in self.kinds[1:])]
        self.start, self.end, self.owner = start, end, owner
        self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.slots_upto = [upto(k > 0) for k in self.kinds]

    def windows(self, n: int, form: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of n template words inside a text; of form 1 and 2, where they differ from form 0."""
        word = self.hashes[form]
        k = len(word) - n + 1
        if k <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        inside = self.owner[:k] == self.owner[n - 1 :]
        if form:
            inside &= self.differs[form][n : n + k] > self.differs[form][:k]
        at = np.flatnonzero(inside)
        h = np.full(len(at), n, U)
        for i in range(n):
            h = (h + word[at + i]) * U(0x2545F4914F6CDD1D)
            h ^= h >> U(32)
        return words.mix(h), at

    def slots(self, at: int, n: int, form: int = 0) -> list[str]:
        """Type and text of each slot of a window, in order."""
        kind = self.kinds[form]
        return [f"{kind[i]}:" + self.low[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "replace") for i in range(at, at + n) if kind[i]]


FORMS = range(3)
_HIT = "hash long, slots array<string>"


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """item_id, total (windows of the item), n, hash, place and slots of the benchmark's windows."""
    kind = bench.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, t, cut_at = [], Template(strings(pdf["text"])), {}
            for i, item in enumerate(pdf["item_id"].tolist()):
                lo, size = t.first[i], t.first[i + 1] - t.first[i]
                n = int(min(WINDOW, size))
                if n < MIN_WORDS:
                    continue
                total, whole = 0, None
                for form in FORMS:
                    if (n, form) not in cut_at:
                        cut_at[n, form] = t.windows(n, form)
                    h, at = cut_at[n, form]
                    mine = slice(*np.searchsorted(at, (lo, t.first[i + 1])))
                    h, at = h[mine].view(np.int64), at[mine]
                    upto = t.slots_upto[form]
                    good = 2 * (n - (upto[at + n] - upto[at])) >= n
                    if not form:
                        if good.any():
                            h, at = h[good], at[good]
                        total, whole = len(at), at
                    else:  # the same windows in another form
                        good &= np.isin(at, whole)
                        h, at = h[good], at[good]
                    out += [(item, total, n, x, p - lo, t.slots(p, n, form)) for x, p in zip(h.tolist(), at.tolist())]
            yield pd.DataFrame(out, columns=["item_id", "total", "n", "hash", "place", "slots"])

    return bench.select("item_id", "text").mapInPandas(cut, f"item_id {kind}, total int, n int, hash long, place int, slots array<string>")


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the window hashes, made in Spark (BITS / 8 bytes a task), and the window lengths."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, sizes = np.zeros(BITS, bool), set()
        for pdf in batches:
            bits[_slot(pdf["hash"].to_numpy(np.int64).view(U))] = True
            sizes |= set(pdf["n"].tolist())
        if sizes:
            yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()], "sizes": [sorted(sizes)]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BITS // 8, np.uint8)
        for x in pdf["bits"]:
            total |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"bits": [total.tobytes()], "sizes": [sorted({int(s) for x in pdf["sizes"] for s in x})]})

    kind = "bits binary, sizes array<int>"
    parts = windows.select("hash", "n").mapInPandas(fill, kind).groupBy(F.pmod(F.spark_partition_id(), F.lit(32))).applyInPandas(merge, kind)
    found = parts.collect()
    total = np.zeros(BITS // 8, np.uint8)
    for r in found:
        total |= np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(total).astype(bool), sorted({s for r in found for s in r["sizes"]})


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - 23)).astype(np.int64)


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """node (digest of a text), item_id, coverage and kind (verbatim or rewritten) of every contaminated text."""
    spark = docs.sparkSession
    windows = materialise(benchmark_windows(bench))
    bits, sizes = _bitmap(windows)
    shared = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        table = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for pdf in batches:
            texts, nodes = strings(pdf["text"]), pdf["node"].tolist()
            for lo, hi in words.chunks(texts):
                t, out = Template(texts[lo:hi]), []
                for n in sizes:
                    for form in FORMS:
                        h, at = t.windows(n, form)
                        hit = table[_slot(h)]
                        for x, p in zip(h[hit].view(np.int64).tolist(), at[hit].tolist()):
                            out.append((nodes[lo + t.owner[p]], x, t.slots(p, n, form)))
                yield pd.DataFrame(out, columns=["node", "hash", "slots"])

    texts = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "text")
    hits = texts.mapInPandas(probe, f"node binary, {_HIT}").distinct()
    pairs = hits.join(windows.select("item_id", "total", "hash", F.col("place").alias("at"), F.col("slots").alias("asked")), "hash")
    pairs = pairs.select("node", "item_id", "total", "at", F.arrays_zip("asked", "slots").alias("pair"), (F.col("asked") != F.col("slots")).alias("changed"))
    even = F.size(F.array_distinct("pair")) == F.size(F.array_distinct(F.col("pair.asked")))
    names = F.filter("pair", lambda x: x["asked"].startswith("2:"))  # two names don't become one; two numbers may by chance
    even &= F.size(F.array_distinct(names)) == F.size(F.array_distinct(F.transform(names, lambda x: x["slots"])))
    held = materialise(pairs.where(even).groupBy("node", "item_id", "at").agg(F.max("total").alias("total"), F.min("changed").alias("changed")))
    found = held.groupBy("node", "item_id").agg(F.count(F.lit(1)).alias("seen"), F.max("total").alias("total"), F.max("changed").alias("changed"))
    return found.select("node", "item_id", (F.col("seen") / F.col("total")).alias("coverage"), F.when(F.col("changed"), "rewritten").otherwise("verbatim").alias("kind")).where(F.col("coverage") >= COVERAGE)


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage and kind for each document and item found in it."""
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"))
    return rows.join(matches(docs, bench), "node").drop("node")


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents without benchmark items, all columns."""
    marked = docs.withColumn("__node", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return marked.join(materialise(matches(docs, bench).select(F.col("node").alias("__node")).distinct()), "__node", "left_anti").drop("__node")


def op6(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "kind")

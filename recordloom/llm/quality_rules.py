"""Quality rules by weak supervision.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or
abstains (0). Some rules are sharp, some are weak signals that many good texts
set off (a short text, few different words); each way of being bad is seen by
two rules at least. Expectation-maximisation over the counts of vote patterns
estimates, with no labels, how often each rule votes bad on good and on bad
documents. Nothing holds a rate within bounds: a rule that votes bad on both
alike loses its say, and a bad vote is outvoted where the rates say so. The
posterior probability of good replaces an all-must-pass filter. The only thing
gathered is one count for each vote pattern: at most 3**len(RULES) numbers,
whatever the size of the corpus.

Defined cases: a null or empty text has zero words and fails the base rules; an
empty table gives no rows; repeated rows are scored alike; further columns of
the input are carried along by `apply` unless they have the name of one of its
own; `keep_good` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from . import words
from .common import per_owner, release, strings

SYMBOLS = "#*$%&|<>"
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_letters", "n_bare", "n_stressed", "n_shouted", "n_long",
]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document is kept while its posterior probability of being good is at least this.
KEEP_AT = 0.5


@dataclass(frozen=True)
class Rule:
    """Votes bad where value is beyond `bad`, good where it is within `good`, else abstains.

    value is a ratio of two counts (or one count, without `under`); where the lower is under `least`, the rule
    abstains. A rule with bad < good votes bad on low values.
    """

    name: str
    over: str
    under: str
    good: float
    bad: float
    least: int = 1


RULES = [
    Rule("symbols", "n_symbols", "n_words", 0.1, 0.3),
    Rule("upper_case", "n_upper", "n_letters", 0.1, 0.3),
    Rule("shouted_words", "n_shouted", "n_words", 0.1, 0.3),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.1, 0.3, 5),
    Rule("repeated_windows", "n_repeat_words", "n_words", 0.1, 0.3, 20),
    Rule("bare_symbols", "n_bare", "n_words", 0.02, 0.1),
    Rule("stressed_words", "n_stressed", "n_words", 0.1, 0.3),
    Rule("long_words", "word_chars", "n_words", 7.0, 9.0),
    Rule("very_long_words", "n_long", "n_words", 0.02, 0.1),
    Rule("few_different", "n_distinct", "n_words", 0.65, 0.55, 50),
    Rule("short_text", "n_words", "", 150, 80),
]

#: Kinds of every code point: 1 a letter, 2 upper case, 4 a symbol.
_KIND = np.frombuffer(bytes(chr(i).isalpha() | chr(i).isupper() << 1 for i in range(0x110000)), np.uint8).copy()
_KIND[[ord(c) for c in SYMBOLS]] |= 4


def count_texts(texts: list[str]) -> np.ndarray:
    """COUNTS of each text, one row per text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for lo, hi in words.chunks(texts):
        out[lo:hi] = _count_chunk(texts[lo:hi])
    return out


def _later_copies(key: np.ndarray) -> np.ndarray:
    """True where an earlier element has the same key."""
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return again


def _count_chunk(texts: list[str]) -> np.ndarray:
    n, b = len(texts), words.batch(texts)
    tag = words.mix(np.arange(1, n + 1))
    kind = _KIND[b.codes]
    upto = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    inside = lambda mask: np.diff(upto(mask)[b.bounds])
    length = b.ends - b.starts

    newline = np.flatnonzero(b.codes == 10)
    line_start = np.unique(np.concatenate((b.bounds[:-1], newline + 1)))
    line_start = line_start[line_start < len(b.codes)]
    line_owner = np.searchsorted(b.bounds, line_start, side="right") - 1
    line_end = np.minimum(np.append(newline, len(b.codes))[np.searchsorted(newline, line_start)], b.bounds[line_owner + 1])
    line_words = np.searchsorted(b.starts, line_end) - np.searchsorted(b.starts, line_start)
    line_start, line_end, line_owner = (x[line_words > 0] for x in (line_start, line_end, line_owner))
    dup = _later_copies(words.mix(words.span_hashes(b.codes, line_start, line_end) ^ tag[line_owner]))

    h, at = words.windows(b, 3)
    key = h ^ tag[b.owner[at]]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(len(key), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    step = np.zeros(len(b.starts) + 1, np.int64)
    np.add.at(step, at[repeated], 1)
    np.add.at(step, at[repeated] + 3, -1)
    covered = np.cumsum(step[:-1]) > 0

    letters = upto(kind & 1)
    bare = letters[b.ends] == letters[b.starts]
    ups, within = upto(kind & 2 != 0), letters[b.ends] - letters[b.starts]
    shouted = (within > 1) & (ups[b.ends] - ups[b.starts] == within)
    last = b.codes[b.ends - 1] if len(b.ends) else b.codes[:0]
    doubled = (last == b.codes[np.maximum(b.ends - 2, 0)]) & (kind[b.ends - 1] & 1 == 0) & ((last < 48) | (last > 57)) if len(b.ends) else length > 0
    stressed = (length > 1) & ((last == 33) | doubled)
    return np.stack([
        np.diff(b.first),
        per_owner(b.owner, n, length),
        inside(kind & 4 != 0),
        per_owner(line_owner[dup], n),
        per_owner(b.owner[covered], n),
        per_owner(line_owner, n),
        per_owner(b.owner[~_later_copies(b.hashes ^ tag[b.owner])], n),
        inside(kind & 2 != 0),
        inside(kind & 1 != 0),
        per_owner(b.owner[bare], n),
        per_owner(b.owner[stressed], n),
        per_owner(b.owner[shouted], n),
        per_owner(b.owner[length >= 20], n),
    ], axis=1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeat = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def votes(counts: np.ndarray) -> np.ndarray:
    """One column of -1, 0 or 1 for each rule."""
    out = np.zeros((len(counts), len(RULES)), np.int8)
    for j, r in enumerate(RULES):
        over = counts[:, COUNTS.index(r.over)]
        under = counts[:, COUNTS.index(r.under)] if r.under else np.full(len(counts), r.least)
        value = over / np.maximum(under, 1)
        bad, good = (value > r.bad, value <= r.good) if r.bad > r.good else (value < r.bad, value >= r.good)
        out[:, j] = np.where(under < r.least, 0, np.where(bad, -1, np.where(good, 1, 0)))
    return out


def pattern_ids(v: np.ndarray) -> np.ndarray:
    """Each row of votes as one number in base 3."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(len(RULES)))


def _pattern_votes(ids: np.ndarray) -> np.ndarray:
    return (ids[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1).astype(np.int8)


def fit(ids: np.ndarray, weight: np.ndarray, rounds: int = 2000, prior_bad: float = 0.1, trust: float = 0.01) -> dict:
    """EM over vote patterns and their counts, for a good and a bad class, in which rules vote independently.

    bad_vote[k, j] is the probability that rule j, where it votes, votes bad in class k (0 good, 1 bad). It
    starts from 0.02 for good and 0.3 for bad documents, which tells the classes apart; pseudo-votes at these
    rates, worth `trust` of all documents, are the prior.
    """
    v, total, n = _pattern_votes(ids), max(1.0, float(weight.sum())), len(RULES)
    start, first = np.array([np.full(n, 0.02), np.full(n, 0.3)]), np.array([1 - prior_bad, prior_bad])
    model, held = {"bad_vote": start, "share": first}, trust * total * first[:, None]
    for _ in range(rounds):
        w = weight[:, None] * _classes(v, model)
        bad, good = w.T @ (v == -1), w.T @ (v == 1)
        rate = (bad + held * start) / (bad + good + held)
        share = (w.sum(0) + trust * total * first) / (total + trust * total)
        done = max(np.abs(rate - model["bad_vote"]).max(), np.abs(share - model["share"]).max()) < 1e-10
        model = {"bad_vote": rate, "share": share}
        if done:
            break
    return model


def _classes(v: np.ndarray, model: dict) -> np.ndarray:
    """Probability of each class for each row of votes."""
    rate = model["bad_vote"]
    log = (v == -1) @ np.log(rate).T + (v == 1) @ np.log1p(-rate).T + np.log(model["share"])
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def posterior(v: np.ndarray, model: dict) -> np.ndarray:
    """Probability of good for each row of votes."""
    return _classes(v, model)[:, 0]


def fit_frame(docs: DataFrame, text: str = "text") -> dict:
    """The model of a whole table: vote patterns are counted in Spark, EM runs on their counts."""

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = np.zeros(3 ** len(RULES), np.int64)
        for pdf in batches:
            tally += np.bincount(pattern_ids(votes(count_texts(strings(pdf["t"])))), minlength=len(tally))
        seen = np.flatnonzero(tally)
        yield pd.DataFrame({"pattern": seen, "n": tally[seen]})

    rows = docs.select(F.col(text).alias("t")).mapInPandas(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return fit(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float))


def apply(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """Adds the counts, base_failed, p_good and kept to the columns `keep` (all by default)."""
    keep = docs.columns if keep is None else keep
    clash = set(COUNTS) | {"base_failed", "p_good", "kept", "__text"}
    own = [c for c in keep if c not in clash]
    fields = [docs.schema[c] for c in own]
    out = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("p_good", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = count_texts(strings(pdf["__text"]))
            p, failed = posterior(votes(counts), model), base_failed(counts)
            added = pd.DataFrame(counts, columns=COUNTS, index=pdf.index).assign(base_failed=failed, p_good=p, kept=~failed & (p >= keep_at))
            yield pd.concat([pdf[own], added], axis=1)

    return docs.select(*own, F.col(text).alias("__text")).mapInPandas(score, out)


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """Fit on the whole table, then score it."""
    return apply(docs, fit_frame(docs, text), text, keep, keep_at)


def keep_good(docs: DataFrame, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that pass the base rules and are good by the posterior, all columns."""
    model = fit_frame(docs, text)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = count_texts(strings(pdf[text]))
            yield pdf[~base_failed(counts) & (posterior(votes(counts), model) >= keep_at)]
        release()  # the next stage's work runs in this worker

    return docs.mapInPandas(choose, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 9).alias("p_good"))

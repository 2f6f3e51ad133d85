"""Personal data: fixed patterns, and a conditional random field for the rest.

The linear-chain field labels words as part of a phone number, an id number, a
written-out mail address or a name, from the shapes of the word and its
neighbours and a few cue words. It is trained on a small labelled table (made
by rule in `training_table`, or given), by gradient steps on the exact
log-likelihood, and decoded by Viterbi over numpy batches of all sentences of
every text. The trained field of the default table lies beside this file, with
the table's hash; it is trained anew where the hash differs. A sentence is
decoded in chains of at most CHAIN words (one transition in CHAIN is left out of
a longer one; features look across).

Spans of the field that overlap a pattern's span are dropped: the pattern's stays.
A name without any cue (title, "name is", "contact", a greeting) isn't found.

Defined cases: a null text counts as empty (`redact` leaves it null); repeated
rows get the same result; an empty table gives no rows; further columns are
carried by `redact` and ignored by `find`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from . import words
from .common import release, strings

BASE = ["email", "ip", "card", "phone"]
FIELD = ["crf_phone", "crf_id", "crf_mail", "crf_name"]
LABELS = ["O", *(f"{p}-{k}" for k in FIELD for p in "BI")]
U = np.uint64

#: Words that announce personal data (fixed values).
CUES = {
    "phone": "phone tel telephone whatsapp call mobile cell",
    "id": "ssn passport social security licence license iban taxid",
    "at": "at (at) [at] {at}",
    "dot": "dot (dot) [dot] {dot}",
    "title": "mr mrs ms dr prof herr frau monsieur madame señor señora",
    "name": "name named contact dear regards sincerely signed",
    "is": "is",
}
#: Words that a chain of the decoder holds at most.
CHAIN = 128
FILE = Path(__file__).with_name("pii_field.json")
_CUE_NAMES = list(CUES)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each at sign takes the whole run before it, back to the last match, if a domain follows."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


_NOT_DIGIT = re.compile("[^0-9]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the fixed patterns, by start, then in the order of BASE."""
    found = [(*s, "email") for s in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], BASE.index(s[2])))


# --- the field -------------------------------------------------------------


def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((int(h), i) for i, name in enumerate(_CUE_NAMES) for h in words.batch(CUES[name].split()).hashes)
    return np.array([p[0] for p in pairs], U), np.array([p[1] for p in pairs], np.int64)


_CUE_HASH, _CUE_KIND = _cue_table()


@dataclass
class Words:
    """Words of some texts with what the field sees: shape hashes, cues (or -1), and sentence numbers."""

    b: words.Batch
    shape: np.ndarray
    cue: np.ndarray
    sentence: np.ndarray


def look(texts: list[str]) -> Words:
    b = words.batch(texts, hashed=False)
    low, kinds = words.fold(b.codes)
    upto = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    # Shape: upper X, lower x, digit d, signs as they are; runs of one letter kind count once.
    sign = np.where(kinds == 1, 1, np.where(kinds == 2, 2, np.where(kinds == 3, 3, b.codes + 16))).astype(np.uint32)
    keep = np.ones(len(sign), bool)
    if len(sign) > 1:
        keep[1:] = (sign[1:] != sign[:-1]) | (sign[1:] > 2)
        keep[b.starts] = True
    place = upto(keep)
    shape = words.span_hashes(sign[keep], place[b.starts], place[b.ends])
    # Cues: the lower-case word, without a colon, comma or full stop at its end.
    last = low[b.ends - 1] if len(b.ends) else np.zeros(0, np.uint32)
    trim = np.isin(last, [44, 46, 58]) & (b.ends - b.starts > 1)
    h = words.span_hashes(low, b.starts, b.ends - trim)
    at = np.minimum(np.searchsorted(_CUE_HASH, h), len(_CUE_HASH) - 1)
    cue = np.where(_CUE_HASH[at] == h, _CUE_KIND[at], -1)
    fresh = np.ones(len(b.starts), bool)
    if len(b.starts) > 1:
        lines = upto(b.codes == 10)
        ends = np.isin(last[:-1], [33, 46, 63]) & (cue[:-1] != _CUE_NAMES.index("title"))
        fresh[1:] = (b.owner[1:] != b.owner[:-1]) | ends | (lines[b.starts[1:]] > lines[b.starts[:-1]])
    return Words(b, shape, cue, np.cumsum(fresh) - 1)


@dataclass
class Model:
    """Known shapes (sorted hashes), weights per feature and label, and transition weights."""

    shapes: np.ndarray
    weights: np.ndarray
    moves: np.ndarray


def _features(w: Words, shapes: np.ndarray) -> np.ndarray:
    """Feature numbers of each word, one column per template; 0 is 'none'.

    Templates: shape here, before, after; cue here, one and two before, one, two and three after. A neighbour
    lies in the same sentence.
    """
    n, s = len(w.shape), len(shapes)
    at = np.minimum(np.searchsorted(shapes, w.shape), max(0, s - 1))
    known = np.where(shapes[at] == w.shape, at + 1, 0) if s else np.zeros(n, np.int64)
    cue = w.cue + 1

    def beside(x: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if n > abs(d):
            a, b = (slice(d, None), slice(None, -d)) if d > 0 else (slice(None, d), slice(-d, None))
            out[b] = np.where(w.sentence[a] == w.sentence[b], x[a], 0)
        return out

    c = len(_CUE_NAMES)
    columns = [(known, s), (beside(known, -1), s), (beside(known, 1), s), (cue, c), (beside(cue, -1), c), (beside(cue, -2), c), (beside(cue, 1), c), (beside(cue, 2), c), (beside(cue, 3), c)]
    out, base = np.zeros((n, len(columns)), np.int64), 1
    for j, (x, size) in enumerate(columns):
        out[:, j] = np.where(x > 0, x - 1 + base, 0)
        base += size
    return out


def _n_features(shapes: np.ndarray) -> int:
    return 1 + 3 * len(shapes) + 6 * len(_CUE_NAMES)


def training_table(seed: int = 20) -> list[tuple[list[str], list[str]]]:
    """Small labelled sentences: personal data of each kind among invented words, made by rule."""
    rng = np.random.default_rng(seed)
    syllables = "an be cor du el fi gan hor in jo ka lum men nor ola per qui ra sil tor un ver wa xi yon zet".split()
    pick = lambda x: x[int(rng.integers(len(x)))]

    def word(capital: bool = False) -> str:
        x = "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
        return x.capitalize() if capital else x

    def digits(n: int) -> str:
        return "".join(str(int(d)) for d in rng.integers(0, 10, n))

    def filler(n: int, opens: bool = True) -> tuple[list[str], list[str]]:
        out = [word(opens and i == 0 or rng.random() < 0.08) + (pick([",", ".", "***", "%%%", "###", "$$$", "&&&", "!!", ""]) if rng.random() < 0.3 else "") for i in range(n)]
        return out, ["O"] * n

    def tagged(ws: list[str], kind: str) -> tuple[list[str], list[str]]:
        return ws, [f"{'B' if i == 0 else 'I'}-{kind}" for i in range(len(ws))]

    def some() -> list[tuple[list[str], list[str]]]:
        end = pick(["", "", ".", ","])
        kind = int(rng.integers(0, 13))
        cased = lambda x: x.capitalize() if rng.random() < 0.6 else x
        cue = lambda name: ([cased(pick(CUES[name].split())) + pick(["", ":", "."] if name == "title" else ["", ":"])], ["O"])
        either = lambda name: CUES[name].split()[0] if rng.random() < 0.5 else pick(CUES[name].split())
        name = lambda: pick([word(True), word(True), f"{word(True)}-{word(True)}", f"O'{word(True)}"])
        names = lambda: tagged([name() for _ in range(int(pick([0, 1, 1])))] + [name() + end], "crf_name")
        if kind == 0:
            return [tagged([f"{digits(3)}-{digits(3)}-{digits(4)}{end}"], "crf_phone")]
        if kind == 1:
            return [tagged([f"({digits(3)})", f"{digits(3)}-{digits(4)}{end}"], "crf_phone")]
        if kind == 2:
            return [cue("phone"), tagged([digits(3), digits(int(pick([3, 4]))), digits(4) + end], "crf_phone")]
        if kind == 3:
            return [tagged([f"{digits(3)}-{digits(2)}-{digits(4)}{end}"], "crf_id")]
        if kind == 4:
            return [cue("id"), tagged([pick(["AB", "C", "XK"]) + digits(int(rng.integers(6, 10))) + end], "crf_id")]
        if kind in (5, 6):
            return [tagged([word(), either("at"), word(), either("dot"), pick(["com", "org", "net"]) + end], "crf_mail")]
        if kind == 7:
            return [cue("title"), names()]
        if kind == 8:
            return [pick([(["my", "name", "is"], ["O"] * 3), (["name", "is"], ["O"] * 2), ([cased("name") + ":"], ["O"]), (["My", "name", "is"], ["O"] * 3)]), names()]
        if kind == 9:
            w = pick(["contact", "Contact", "dear", "Dear", "regards,", "Regards,", "Sincerely,", "signed", "named"])
            return [([w], ["O"]), names()]
        if kind == 10:  # cues in ordinary use
            w = pick(["at", "dot", "name", "contact", "dear", "call", "is", "signed", "named", "phone", *CUES["title"].split(), *(x.capitalize() for x in CUES["title"].split()), "is", "at", "dot", "at the", "dot on", "is a", "is the", "the dot", "at the dot on", "at a dot in", "name of", "contact us", "is not"]).split()
            return [(w, ["O"] * len(w)), ([word(), word(rng.random() < 0.3) + end], ["O", "O"])]
        if kind == 11:  # a capital after words that are no cue
            return [([pick(["is", "Is", "at", "the", "of", "name of the"]), *(word(True) for _ in range(int(rng.integers(1, 4)))), word() + end], None)]
        # numbers that aren't personal
        return [([pick([digits(int(rng.integers(1, 9))), f"{digits(2)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}", f"{digits(1)}-{digits(1)}", f"{digits(2)}%", word() + digits(2), digits(16)]) + end], ["O"])]

    out = []
    for _ in range(1300):
        parts = [filler(int(rng.integers(0, 6))), *some(), filler(int(rng.integers(0, 6)), rng.random() < 0.2)]
        parts = [(" ".join(ws).split(), ["O"] * len(" ".join(ws).split()) if ls is None else ls) for ws, ls in parts]
        out.append((sum((p[0] for p in parts), []), sum((p[1] for p in parts), [])))
    for name in CUES:  # cue words alone say nothing
        for _ in range(30):
            parts = [filler(2), ([pick(CUES[name].split()) + pick(["", ".", ","])], ["O"]), ([word(), pick(["4.0.", word(), "word"])], ["O", "O"]), filler(3)]
            out.append((sum((p[0] for p in parts), []), sum((p[1] for p in parts), [])))
    out += [filler(int(rng.integers(1, 14))) for _ in range(400)] + [filler(int(rng.integers(1, 4)), False) for _ in range(150)]
    for _ in range(150):  # shouting, capitals and signs between words
        ws = filler(int(rng.integers(4, 14)))[0] + ["is", "at"][: int(rng.integers(0, 3))]
        change = pick([str.upper, lambda x: x.upper() + pick(["!!", ",", ""]), str.capitalize, lambda x: pick([x, x, "|", "-", "&", "A", "1"])])
        ws = [change(x) for x in ws]
        out.append((ws, ["O"] * len(ws)))
    return out


class Likelihood:
    """Log-likelihood of a labelled table and its gradient; all sentences go through forward and backward at once."""

    def __init__(self, table: list[tuple[list[str], list[str]]]):
        w = look([" ".join(ws) for ws, _ in table])
        w.sentence = w.b.owner  # each row of the table is one sentence
        self.n, self.k = len(table), len(LABELS)
        self.gold = np.array([LABELS.index(x) for _, ls in table for x in ls], np.int64)
        shapes, seen = np.unique(w.shape, return_counts=True)
        self.shapes = shapes[seen >= 2]
        self.f = _features(w, self.shapes)
        size = np.diff(w.b.first)
        self.steps = int(size.max())
        self.at = w.b.first[:-1, None] + np.minimum(np.arange(self.steps), size[:, None] - 1)
        self.live = np.arange(self.steps) < size[:, None]
        self.gold_w, self.gold_m = np.zeros((_n_features(self.shapes), self.k)), np.zeros((self.k, self.k))
        for j in range(self.f.shape[1]):
            np.add.at(self.gold_w, (self.f[:, j], self.gold), 1)
        inner = w.b.owner[1:] == w.b.owner[:-1]
        np.add.at(self.gold_m, (self.gold[:-1][inner], self.gold[1:][inner]), 1)

    def __call__(self, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Sum over the sentences, and its derivatives by weights and moves."""
        n, k, steps, live = self.n, self.k, self.steps, self.live
        e = weights[self.f].sum(1)[self.at]
        alpha, beta = np.zeros((steps, n, k)), np.zeros((steps, n, k))
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha[0] = e[:, 0]
        for t in range(1, steps):
            alpha[t] = np.where(live[:, t, None], lse(alpha[t - 1][:, :, None] + moves, 1) + e[:, t], alpha[t - 1])
        total = lse(alpha[-1], 1)
        grad_m = self.gold_m.copy()
        p = np.zeros((n, steps, k))
        p[:, -1] = np.exp(alpha[-1] - total[:, None])
        for t in range(steps - 2, -1, -1):
            ahead = e[:, t + 1] + beta[t + 1]
            beta[t] = np.where(live[:, t + 1, None], lse(moves + ahead[:, None, :], 2), 0)
            pair = np.exp(alpha[t][:, :, None] + moves + ahead[:, None, :] - total[:, None, None])
            grad_m -= pair[live[:, t + 1]].sum(0)
            p[:, t] = np.exp(alpha[t] + beta[t] - total[:, None])
        flat = np.zeros((len(self.gold), k))
        flat[self.at[live]] = p[live]
        grad_w = self.gold_w.copy()
        for j in range(self.f.shape[1]):
            np.subtract.at(grad_w, self.f[:, j], flat)
        return float((self.gold_w * weights).sum() + (self.gold_m * moves).sum() - total.sum()), grad_w, grad_m


def train(table: list[tuple[list[str], list[str]]] | None = None, steps: int = 200, ridge: float = 1e-4) -> Model:
    """Maximum likelihood by AdaGrad."""
    goal = Likelihood(training_table() if table is None else table)
    weights, moves = np.zeros_like(goal.gold_w), np.zeros_like(goal.gold_m)
    weights[1:, 0] = 0.1
    sums, start = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)], weights.copy()
    for _ in range(steps):
        weights[0] = 0
        _, grad_w, grad_m = goal(weights, moves)
        for value, first, grad, s in ((weights, start, grad_w, sums[0]), (moves, 0, grad_m, sums[1])):
            g = grad / goal.n - ridge * (value - first)
            s += g * g
            value += 0.5 * g / np.sqrt(s)
    weights[0] = 0
    return Model(goal.shapes, weights.round(4), moves.round(4))


def _table_hash() -> str:
    return hashlib.sha256(json.dumps([training_table(), CUES, LABELS]).encode()).hexdigest()


def save(model: Model) -> None:
    """Writes the field of the default table beside this file."""
    FILE.write_text(json.dumps({"table": _table_hash(), "shapes": [int(x) for x in model.shapes], "weights": model.weights.tolist(), "moves": model.moves.tolist()}))


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The stored field, or one trained anew if the table isn't the one it was trained on."""
    held = json.loads(FILE.read_text()) if FILE.exists() else {}
    if held.get("table") != _table_hash():
        return train()
    return Model(np.array(held["shapes"], U), np.array(held["weights"]), np.array(held["moves"]))


def decode(w: Words, m: Model) -> np.ndarray:
    """The likeliest labels of all words; Viterbi runs over all chains at once, longest first."""
    labels = np.zeros(len(w.shape), np.int64)
    if not len(labels):
        return labels
    place = np.arange(len(labels)) - np.searchsorted(w.sentence, w.sentence)
    first = np.flatnonzero(place % CHAIN == 0)
    size = np.diff(np.append(first, len(labels)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    f, e = _features(w, m.shapes), np.zeros((len(labels), len(LABELS)), np.float32)
    weights, moves = m.weights.astype(np.float32), m.moves.astype(np.float32)
    for j in range(f.shape[1]):
        e += weights[f[:, j]]
    score, back = e[first], []
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t))  # chains longer than t
        step = score[:n, :, None] + moves
        best = step.argmax(1)
        back.append(best.astype(np.int8))
        score[:n] = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + e[first[:n] + t]
    now = score.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = int(np.searchsorted(-size, -t))
        labels[first[:n] + t] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return labels


def field_spans(texts: list[str], m: Model) -> list[list[tuple[int, int, str]]]:
    """Spans of the field in each text, without signs around them."""
    w = look(texts)
    labels = decode(w, m)
    out: list[list] = [[] for _ in texts]
    for i in np.flatnonzero(labels > 0).tolist():
        kind, inside = (labels[i] - 1) // 2, (labels[i] - 1) % 2
        d = int(w.b.owner[i])
        start, end = int(w.b.starts[i] - w.b.bounds[d]), int(w.b.ends[i] - w.b.bounds[d])
        while end > start and texts[d][end - 1] in ",.;:!?":
            end -= 1
        if inside and i and labels[i - 1] > 0 and (labels[i - 1] - 1) // 2 == kind and out[d] and w.sentence[i - 1] == w.sentence[i]:
            out[d][-1] = (out[d][-1][0], end, FIELD[kind])
        else:
            out[d].append((start, end, FIELD[kind]))
    return out


def all_spans(texts: list[str], m: Model) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out = []
    for lo, hi in words.chunks(texts):
        part = texts[lo:hi]
        for text, extra in zip(part, field_spans(part, m)):
            base = base_spans(text)
            more = [s for s in extra if s[1] > s[0] and not any(s[0] < b[1] and b[0] < s[1] for b in base)]
            out.append((base, sorted(base + more, key=lambda s: (s[0], (BASE + FIELD).index(s[2])))))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, a count for each base kind and for the field's spans, base_sha256, spans, for every row."""
    m = default_model() if model is None else model
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            found = all_spans(strings(pdf["text"]), m)
            out = {"doc_id": pdf["doc_id"]} | {f"n_{k}": [sum(s[2] == k for s in b) for b, _ in found] for k in BASE}
            out |= {"n_field": [len(s) - len(b) for b, s in found], "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], "spans": [written(s) for _, s in found]}
            yield pd.DataFrame(out)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", n_field long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the first one's kind."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"[{k.removeprefix('crf_').upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows and columns, with personal data in text masked and n_chars (where there is one) counted anew."""
    m = default_model() if model is None else model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in batches:
            texts = strings(pdf["text"])
            new = [masked(t, s) if s else t for t, (_, s) in zip(texts, all_spans(texts, m))]
            yield pdf.assign(text=[None if o is None else x for o, x in zip(pdf["text"], new)])

    out = docs.mapInPandas(run, T.StructType(docs.schema.fields))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Language-model scores by stupid backoff, with counts of the whole corpus.

Documents are encoded in blocks (a few million characters): the block's words as
hashes, and its tokens as indexes of them. Each block sends its different
n-grams, with how often it has them, to buckets by hash. A bucket's rows form
its part of the count table, which is joined to them on the spot: every block
gets what all others have of what it sent, and sums the logarithms per document. A
frequent n-gram is one row for each block, not for each occurrence, and buckets
are made so many that each holds about BUCKET_ROWS rows.

A document is scored by the others: its own counts are taken off first, so that
rare n-grams of its own don't vouch for it. With c the counts that are left, N
the tokens that are left and order n:

    S(w | h) = c(h w) / c(h)       if c(h w) > 0
             = 0.4 * S(w | h')     else, h' without its first word
    S(w)     = c(w) / N            if c(w) > 0, else 0.4 / max(N, 1)

Defined cases: a null or empty text has n_tokens 0 and null scores; repeated
rows count each as a document; an empty table gives no rows; further columns are
ignored. A word is lower-cased text between ASCII white space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words
from .common import bounded_batches, materialise, strings

U = np.uint64
ORDER, BACKOFF = 2, 0.4
BLOCK_CHARS = 5_000_000
BUCKET_ROWS = 2_000_000


def _pack(a: np.ndarray, level: int = 1) -> bytes:
    """Non-negative integers as byte planes, compressed."""
    a = a.astype("<u8")
    planes = a.view(np.uint8).reshape(-1, 8)
    used = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([used]) + zlib.compress(np.ascontiguousarray(planes[:, :used].T).tobytes(), level)


def _unpack(data: bytes) -> np.ndarray:
    used = data[0]
    raw = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :used] = raw.T
    return out.view("<u8").reshape(-1)


def _pack_keys(sorted_keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys by their differences."""
    return _pack(np.diff(sorted_keys, prepend=U(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data).astype(U))


class Block:
    """The n-grams of a block, for each order: sorted keys, counts, and each window's key index and document."""

    def __init__(self, vocabulary: np.ndarray, codes: np.ndarray, sizes: np.ndarray, order: int):
        self.sizes, h = sizes, vocabulary[codes]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.grams = []
        for n in range(1, order + 1):
            k = max(0, len(h) - n + 1)
            at = np.flatnonzero(owner[:k] == owner[n - 1 : n - 1 + k])
            key = np.full(len(at), n, U)
            for i in range(n):
                key = (key ^ h[at + i]) * U(0x9E3779B97F4A7C15)
                key ^= key >> U(32)
            keys, inverse, counts = np.unique(words.mix(key), return_inverse=True, return_counts=True)
            self.grams.append((keys, counts, at, inverse, owner[at]))

    @staticmethod
    def load(row, order: int) -> Block:
        return Block(np.frombuffer(row.vocabulary, U), _unpack(row.codes).astype(np.int64), np.asarray(row.sizes, np.int64), order)

    def score(self, totals: list[np.ndarray], corpus: int) -> np.ndarray:
        """Sum of log10 scores of each document. totals: the counts of each order's keys in all other blocks."""
        n_tokens, n_docs = int(self.sizes.sum()), len(self.sizes)
        others = []  # by order: the counts of each window without its own document
        for (keys, counts, _, inverse, doc), total in zip(self.grams, totals):
            pair = doc.astype(np.int64) * max(1, len(keys)) + inverse
            _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
            others.append((total.astype(np.int64) + counts)[inverse] - own[back])
        left = np.maximum(1, corpus - np.repeat(self.sizes, self.sizes))
        log = np.where(others[0] > 0, np.log10(np.maximum(others[0], 1) / left), np.log10(BACKOFF / left)) if n_tokens else np.zeros(0)
        shorter = others[0]
        for n in range(2, len(self.grams) + 1):
            at, count = self.grams[n - 1][2], others[n - 1]
            # windows of order n - 1 are indexed by their first token
            place = np.zeros(n_tokens, np.int64)
            place[self.grams[n - 2][2]] = np.arange(len(self.grams[n - 2][2]))
            history = shorter[place[at]]
            last = at + n - 1
            longer = log[last] + np.log10(BACKOFF)
            log[last] = np.where(count > 0, np.log10(np.maximum(count, 1) / np.maximum(history, 1)), longer)
            shorter = count
        return np.bincount(np.repeat(np.arange(n_docs), self.sizes), log, n_docs)


def blocks(docs: DataFrame) -> DataFrame:
    """The encoded blocks of a table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for pdf in batches:
            texts, ids = strings(pdf["text"]), pdf["doc_id"].tolist()
            for lo, hi in words.chunks(texts, BLOCK_CHARS):
                b = words.batch([x.lower() for x in texts[lo:hi]])
                seen, code, count = np.unique(b.hashes, return_inverse=True, return_counts=True)
                rank = np.argsort(-count, kind="stable")
                new = np.empty(len(seen), np.int64)
                new[rank] = np.arange(len(seen))
                own = [None if x is None or x != x else x for x in ids[lo:hi]]
                yield pd.DataFrame({"block": [f"{part}-{number}"], "ids": [own], "sizes": [np.diff(b.first).tolist()], "vocabulary": [seen[rank].tobytes()], "codes": [_pack(new[code], 6)], "n": [len(code)]})
                number += 1

    return docs.select("doc_id", "text").mapInPandas(encode, f"block string, ids array<{kind}>, sizes array<long>, vocabulary binary, codes binary, n long")


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens and log10_score (the sum over the document's words) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    with bounded_batches(docs.sparkSession, 1_200):
        held = materialise(blocks(docs))
    corpus = held.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (order * corpus // BUCKET_ROWS).bit_length())

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                for n, (keys, counts, *_) in enumerate(Block.load(row, order).grams, 1):
                    # only buckets that the block has keys for, however many there are
                    owner = (keys >> U(64 - bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(owner)) + 1
                    parts = [(int(o[0]), k, c) for o, k, c in zip(np.split(owner, cuts), np.split(keys, cuts), np.split(counts, cuts)) if len(k)]
                    yield pd.DataFrame({"gram": n, "bucket": [p[0] for p in parts], "block": row.block, "keys": [_pack_keys(p[1]) for p in parts], "counts": [_pack(p[2]) for p in parts]})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys, counts = [_unpack_keys(x) for x in pdf["keys"]], np.concatenate([_unpack(x) for x in pdf["counts"]])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, counts)[inverse].astype(np.int64)
        # what others have: mostly 0, so that it packs well
        parts = np.split(total - counts.astype(np.int64), np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame({"gram": pdf["gram"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "block": pdf["block"].to_numpy(), "totals": [_pack(x) for x in parts]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                totals = [[] for _ in range(order)]
                for x in sorted(row.answers if row.answers is not None else [], key=lambda x: (x["gram"], x["bucket"])):
                    totals[x["gram"] - 1].append(_unpack(x["totals"]))
                joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in totals]
                sizes = np.asarray(row.sizes, np.int64)
                sums = Block.load(row, order).score(joined, corpus)
                yield pd.DataFrame({"doc_id": pd.Series(list(row.ids), dtype="object"), "n_tokens": sizes, "log10_score": np.where(sizes > 0, sums, np.nan)})

    sent = held.select("block", "sizes", "vocabulary", "codes").mapInPandas(send, "gram int, bucket int, block string, keys binary, counts binary")
    answers = sent.groupBy("gram", "bucket").applyInPandas(count, "gram int, bucket int, block string, totals binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("gram", "bucket", "totals")).alias("answers"))
    found = held.drop("n").join(answers, "block", "left").mapInPandas(score, f"doc_id {kind}, n_tokens long, log10_score double")
    return found.withColumn("log10_score", F.when(F.col("n_tokens") > 0, F.col("log10_score")))


def op2(spark, sf_dir: str) -> DataFrame:
    found = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_tokens", F.round("log10_score", 6).alias("log10_score"), F.round(F.col("log10_score") / F.col("n_tokens"), 9).alias("mean_log10"))

"""Binary output of token ids with Re-Pair grammar compression.

Documents are dealt by ranges of doc_id and sorted, encoded, and put into
blocks. In each block frequent pairs of ids are replaced by nonterminals,
round after round, until no pair has LEAST_USES uses: a round counts all
adjacent pairs, takes the frequent ones and replaces their occurrences from left
to right. No pair crosses the end of a document. A block stores its rules, the expansion length of each rule and the
place of each document, so that one document, or a range of its ids, can be
decoded alone. Blocks are rows of a Parquet table written by Spark, so any
storage that Spark writes will do and a lost executor's tasks are simply redone.

Block layout, little-endian: magic "RLRP", u32 version, u64 documents, u64
rules, u64 symbols, u32 first nonterminal, u32 rounds; then i64 doc ids, u8
null flags, u64 ids per document, u64 first symbol per document, u32 rules of
each round, u32 left and right symbol of each rule, u32 expansion lengths, and
the symbols as two planes of u16 (low halves, then high).

Defined cases: a null or empty text is the end id alone; null doc_ids come
first; repeated rows and equal doc_ids are stored one by one, ordered by text;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tokens, words
from .common import release, shared_dir, strings

MAGIC, VERSION, HEAD = b"RLRP", 1, "<4sIQQQII"
END_ID = 2
FIRST_RULE = 1 << 17
BLOCK_IDS = 1 << 20
#: Uses from which a pair becomes a rule. A rule costs three words of a block and each use saves one, so rules of few uses
#: don't pay: with 8 the blocks of the check tool's documents are smallest (README).
LEAST_USES, SLOTS = 8, 1 << 18


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(14)


def compress(seq: np.ndarray, last: np.ndarray, least: int = LEAST_USES) -> tuple[np.ndarray, list[np.ndarray]]:
    """Symbols and, per round, the rules (pairs of symbols) of a sequence of ids.

    last: True at the last id of each document. Rule i, counted over all rounds,
    is symbol FIRST_RULE + i.
    """
    seq, last, rules, made = seq.astype(np.uint32), last.copy(), [], 0
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        slot = _slots(a, b)
        slot[last[:-1]] = 0
        counts = np.bincount(slot, minlength=SLOTS)
        counts[0] = 0
        often = np.flatnonzero((counts >= least)[slot])
        key = a[often].astype(np.uint64) << np.uint64(32) | b[often]
        ordered = np.sort(key)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[: len(ordered)]
        uses = np.diff(np.append(first, len(ordered)))
        pairs, uses = ordered[first[uses >= least]], uses[uses >= least]
        # a pair is found again by its slot, whose most frequent pair comes first; others wait for the next round
        of_slot, by_use = np.full(SLOTS, -1), np.argsort(uses, kind="stable")
        of_slot[_slots((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))[by_use]] = by_use
        rule = of_slot[slot[often]]
        at, key, rule = often[rule >= 0], key[rule >= 0], rule[rule >= 0]
        same = pairs[rule] == key
        at, rule = at[same], rule[same]
        if not len(at):
            break
        # of positions that overlap, every other one from the left
        begins = np.concatenate(([True], np.diff(at) != 1))
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        odd = (np.arange(len(at)) - run) % 2 == 1
        at, rule = at[~odd], rule[~odd]
        left = np.bincount(rule, minlength=len(pairs)) >= 2
        at, rule = at[left[rule]], rule[left[rule]]
        if not len(at):
            break
        number = np.cumsum(left) - 1
        seq, keep = seq.copy(), np.ones(len(seq), bool)
        seq[at] = FIRST_RULE + made + number[rule]
        last[at] = last[at + 1]
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([pairs[left] >> np.uint64(32), pairs[left] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        made += int(left.sum())
    return seq, rules


def expand(seq: np.ndarray, rules: list[np.ndarray]) -> np.ndarray:
    """The ids of a sequence of symbols."""
    first = FIRST_RULE + sum(map(len, rules))
    for pairs in reversed(rules):
        first -= len(pairs)
        which = seq >= first
        out = np.repeat(seq, np.where(which, 2, 1))
        at = np.flatnonzero(which)
        at = at + np.arange(len(at))
        pair = pairs[seq[which] - first]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def rule_lengths(rules: list[np.ndarray]) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.zeros(sum(map(len, rules)), np.uint32)
    done = 0
    for pairs in rules:
        sizes = [np.where(pairs[:, i] >= FIRST_RULE, out[np.maximum(pairs[:, i], FIRST_RULE) - FIRST_RULE] if done else 1, 1) for i in (0, 1)]
        out[done : done + len(pairs)] = sizes[0] + sizes[1]
        done += len(pairs)
    return out


def write_block(doc_ids: list, parts: list[bytes]) -> bytes:
    """One block of documents (ids as bytes, with their end ids)."""
    sizes = np.array([len(x) // 4 for x in parts], np.uint64)
    ids = np.frombuffer(b"".join(parts), "<u4")
    ends = np.cumsum(sizes.astype(np.int64))
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    seq, rules = compress(ids, last)
    lengths = rule_lengths(rules)
    span = np.ones(len(seq), np.int64)
    rule = seq >= FIRST_RULE
    span[rule] = lengths[seq[rule] - FIRST_RULE]
    first = np.searchsorted(np.cumsum(span), ends - sizes.astype(np.int64), side="right")
    empty = np.array([x is None for x in doc_ids], np.uint8)
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return b"".join([
        struct.pack(HEAD, MAGIC, VERSION, len(parts), len(flat), len(seq), FIRST_RULE, len(rules)),
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(), empty.tobytes(), sizes.astype("<u8").tobytes(), first.astype("<u8").tobytes(),
        np.array([len(x) for x in rules], "<u4").tobytes(), flat.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
        (seq & 0xFFFF).astype("<u2").tobytes(), (seq >> 16).astype("<u2").tobytes(),
    ])


class Block:
    """A read view of one block."""

    def __init__(self, data: bytes):
        magic, version, docs, rules, symbols, base, rounds = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != VERSION or base != FIRST_RULE:
            raise ValueError("not a block of this format")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, empty = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if e else int(x) for x, e in zip(ids, empty)]
        self.sizes, self.first = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        per_round, flat = take("<u4", rounds).astype(np.int64), take("<u4", 2 * rules).reshape(-1, 2)
        self.rules = np.split(flat, np.cumsum(per_round)[:-1]) if rounds else []
        self.lengths = take("<u4", rules)
        self.symbols = take("<u2", symbols).astype(np.uint32) | take("<u2", symbols).astype(np.uint32) << np.uint32(16)

    def all_ids(self) -> list[bytes]:
        data = expand(self.symbols, self.rules).astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(self.sizes)).tolist()]
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start:stop of a document; only the symbols that cover them are expanded."""
        stop = int(self.sizes[doc]) if stop is None else min(stop, int(self.sizes[doc]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        end = int(self.first[doc + 1]) if doc + 1 < len(self.first) else len(self.symbols)
        part = self.symbols[int(self.first[doc]) : end]
        span = np.ones(len(part), np.int64)
        rule = part >= FIRST_RULE
        span[rule] = self.lengths[part[rule] - FIRST_RULE]
        upto = np.cumsum(span)
        lo, hi = np.searchsorted(upto, start, side="right"), np.searchsorted(upto, stop, side="left") + 1
        skip = start - (int(upto[lo - 1]) if lo else 0)
        return expand(part[lo:hi], self.rules)[skip : skip + stop - start]


def write(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Encodes documents in ascending doc_id order and writes their blocks as a Parquet table."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        encoder, end = tokens.byte_encoder(tokenizer), END_ID.to_bytes(4, "little")
        ids, parts, held, before, number = [], [], 0, 0, 0

        def block() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "block": [number], "before": [before], "n_ids": [held], "payload": [write_block(ids, parts)]})

        part = None
        for pdf in batches:
            texts = strings(pdf["text"])
            part = int(pdf["part"].iloc[0]) if part is None and len(pdf) else part
            for lo, hi in words.chunks(texts, tokens.BATCH_CHARS):
                for doc_id, data in zip(pdf["doc_id"].iloc[lo:hi].tolist(), encoder.encode(texts[lo:hi])):
                    ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
                    parts.append(data + end)
                    held += len(data) // 4 + 1
                    if held >= block_ids:
                        yield block()
                        before, number = before + held, number + 1
                        ids, parts, held = [], [], 0
        if parts:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.withColumn("part", F.spark_partition_id()).mapInPandas(encode, "part int, block int, before long, n_ids long, payload binary").write.mode("error").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32.

    A part's first id number is the sum over the parts before it; there is one
    row for each part, so that window is small.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, data in zip(pdf["at"], pdf["payload"]):
                b = Block(data)
                starts = int(at) + np.concatenate(([0], np.cumsum(b.sizes)[:-1])).astype(np.int64) if len(b.sizes) else []
                yield pd.DataFrame({"doc_id": pd.array(b.doc_ids, "Int64"), "start": starts, "n_tokens": b.sizes, "ids_crc32": [zlib.crc32(x) for x in b.all_ids()]})

    return blocks.join(F.broadcast(starts), "part").select((F.col("base") + F.col("before")).alias("at"), "payload").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)

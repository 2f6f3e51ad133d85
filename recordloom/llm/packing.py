"""Harmonic packing of documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds lengths in
(C/(k+1), C/k], and k of its pieces, however long, fit one sequence. Every
worker fills the bins of each class on its own with exactly k pieces, so that
nothing is shuffled. Documents are cut so that pieces lie at the upper end of
their classes, C//k tokens, down to a remainder short enough that its class
wastes little; the shortest remainders are packed one after another (next fit,
as harmonic packing does with its last class). A worker's unfinished bins are
joined at its end and cut at the capacity, the last rest at powers of two.

Workers are the partitions of the input. A recomputed task reads the same rows
in the same order and so makes the same pieces. A worker's memory holds one
open bin for each class, at most CLASSES * capacity ids, and one batch.

Defined cases: a null or empty text is the end id alone; a null doc_id stays
null; repeated rows are packed one by one; an empty table gives no pieces;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import tokens, words
from .common import release, strings

CAPACITY = 4096
#: Classes with a fixed count of pieces; shorter pieces are packed one after another.
CLASSES = 64
#: Pieces of this class or above are not cut further: its bins waste at most 1 in 17.
WHOLE_FROM = 16
END_ID = 2


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        size = n if k >= WHOLE_FROM or n == capacity // k else capacity // (k + 1)
        out.append(size)
        n -= size
    return out


class Packer:
    """The bins of one worker. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, worker << 32
        self.open: dict[int, list] = {}
        self.tail: list = []
        self.tail_size = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for size in cut(total, self.capacity):
            piece = (doc_id, start, ids[4 * start : 4 * (start + size)], total)
            start += size
            k = self.capacity // size
            if k >= CLASSES:
                if self.tail_size + size > self.capacity:
                    self._close(self.tail)
                    self.tail, self.tail_size = [], 0
                self.tail.append(piece)
                self.tail_size += size
                continue
            pieces = self.open.setdefault(k, [])
            pieces.append(piece)
            if len(pieces) == k:
                self._close(self.open.pop(k))

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, ids))
            offset += n
        self.next_id += 1

    def finish(self) -> None:
        """Joins the unfinished bins, cutting pieces at the ends of sequences."""
        rest = [p for k in sorted(self.open) for p in self.open[k]] + self.tail
        self.open, self.tail, self.tail_size = {}, [], 0
        left = sum(len(p[2]) // 4 for p in rest)
        room, now = 0, []
        for doc_id, start, ids, total in rest:
            while ids:
                if not room:
                    if now:
                        self._close(now)
                    room, now = min(self.capacity, 1 << (left.bit_length() - 1)), []
                part, ids = ids[: 4 * room], ids[4 * room :]
                n = len(part) // 4
                now.append((doc_id, start, part, total))
                start, room, left = start + n, room - n, left - n
        if now:
            self._close(now)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds its ids as binary (little-endian unsigned 32-bit)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in PIECE.split(", ")), "ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        packer = Packer(TaskContext.get().partitionId(), capacity)
        encoder = tokens.word_encoder(tokenizer)
        end = END_ID.to_bytes(4, "little")

        def frame() -> pd.DataFrame:
            columns = list(zip(*packer.take())) or [[]] * len(names)
            out = {n: np.array(x, np.int64) for n, x in zip(names[1:-1], columns[1:-1])}
            first = pd.Series(columns[0], dtype="object" if kind == "string" else "Int64")
            return pd.DataFrame({"doc_id": first} | out | ({"ids": list(columns[-1])} if with_ids else {}))

        for pdf in batches:
            texts, ids = strings(pdf["text"]), pdf["doc_id"].tolist()
            for lo, hi in words.chunks(texts, tokens.BATCH_CHARS):
                for doc_id, data in zip(ids[lo:hi], encoder.encode(texts[lo:hi])):
                    packer.add(None if doc_id is None or doc_id != doc_id else doc_id, data + end)
                yield frame()
        packer.finish()
        yield frame()

    return docs.select("doc_id", F.col("text")).mapInPandas(run, f"doc_id {kind}, {PIECE}" + ", ids binary" * with_ids)


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

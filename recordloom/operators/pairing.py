"""Steps of the similarity join over batches of hashed word sets, as used by consolidation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

#: Counters in the sketch of word counts, bits in the one of sets asked for, chunks in which either is handed on.
COUNTERS, MARKS, CHUNKS = 1 << 20, 1 << 24, 64
#: Pairs that a task compares at once, words and pairs that a step holds at once.
CELL, WORDS, ROWS = 10_000, 1_000_000, 1_000_000
#: Steps of the logarithm of sizes in 1 / threshold; four times that are less than 64.
STEPS = 12
#: How many keys two similar sets have in common, one at least where sets are too small for more.
SHARED = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def _sets(batch: pa.RecordBatch):
    """Slices of a batch of about so many WORDS: the first row, all hashes in one array, the size of each set."""
    column = batch.column("words")
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS, "right")) - 1)
        yield at, flat[ends[at] : ends[to]], np.diff(ends[at : to + 1]).astype(np.int64)
        at = to


def survey(batches):
    """Adds two hashes of each set, which don't depend on the order of words, and its least mixed hash as block; at the end the counts of the partition's words."""
    counts, like = np.zeros(COUNTERS, np.int64), None
    for batch in batches:
        found = []
        for _, words, sizes in _sets(batch):
            counts += np.bincount(words & (COUNTERS - 1), minlength=COUNTERS)
            at, mixed = np.cumsum(sizes) - sizes, _mix(words)
            # 40 bits of the first take less room in keys; sets that share them are told apart by the second
            found.append([np.add.reduceat(mixed, at) >> np.uint64(24), np.add.reduceat(_mix(mixed + np.uint64(1)), at), np.minimum.reduceat(mixed, at)])
        if found:
            like = batch.schema
            yield _with(batch, *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)), pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary()))
    if like is not None:
        parts = [x.tobytes() for x in np.minimum(counts, 65_535).astype(np.uint16).reshape(CHUNKS, -1)]
        empty = pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, f.type) for f in like], names=like.names)
        yield _with(empty, *[pa.nulls(CHUNKS, pa.int64())] * 3, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary()))


def _with(batch, *columns):
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "s", "s2", "block", "chunk", "counts"])


def total(pdf: pd.DataFrame) -> pd.DataFrame:
    sums = sum(np.frombuffer(x, np.uint16).astype(np.int64) for x in pdf["counts"])
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [np.minimum(sums, 2**31 - 1).astype(np.int32).tobytes()]})


def sketch(rows) -> np.ndarray:
    """At least how many sets a word is in, by its hash; never too few (but for the most frequent ones)."""
    return np.concatenate([np.frombuffer(r["counts"], np.int32) for r in sorted(rows, key=lambda r: r["chunk"])]) if rows else np.zeros(COUNTERS, np.int32)


def classes(threshold: float, largest: int) -> np.ndarray:
    """First size of each class of sizes: partners of a set that aren't smaller are in its class or the next one."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1], int(out[-1] / threshold + 1e-9)) + 1)
    return np.array([*out, max(out[-1], int(out[-1] / threshold + 1e-9)) + 1], np.int64)


def _up(x):
    return np.ceil(x - 1e-9).astype(np.int64)


def bins(low: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the words of a class (0: a key is a single word) and keys to share; two sets share at least threshold * low words, not fewer than both together."""
    shared, wanted = _up(threshold * low), np.round(0.7 * (1 - threshold) * low)
    many = shared >= 2 * SHARED
    m = np.where(many, np.minimum(shared - SHARED, np.maximum(SHARED, wanted)), np.minimum(shared - 1, np.maximum(1, wanted)))
    return m.astype(np.int64), np.where(many, SHARED, 1)


def heads(sizes: np.ndarray, threshold: float):
    """Class, bins, keys to share and number of rarest words to take of each set, once as the larger of a pair and once as the smaller one in the next class."""
    low = classes(threshold, int(sizes.max(initial=1)))
    own = np.searchsorted(low, sizes, "right") - 1
    m, x = bins(low[own], threshold)
    yield own, m, x, np.minimum(sizes, sizes - _up(threshold * sizes) + m + x)
    after = low[own + 1]
    m, x = bins(after, threshold)
    take = sizes - _up(threshold / (1 + threshold) * (sizes + after)) + m + x
    yield own + 1, m, x, np.where(after * threshold <= sizes + 1e-9, np.clip(take, 0, sizes), 0)


def keys(held, threshold: float):
    """Keys of each set; two sets that reach the threshold have SHARED in common, small ones one.

    Two sets that share k words or more share j + x of them among the n - k + j + x rarest of either, whatever the order of
    words, if that is the same for all sets. With these words dealt to j bins, as many as x or more, x pairs of shared ones lie in
    one bin each: a key is a pair of words of a bin. Only where sets are too small for that a key is a word. The last 16 bits of a key
    tell the set's size, where the later word stands and in which role it is; see `_may`.
    """
    step = _step(threshold)

    def run(batches):
        rarity = held.value
        for batch in batches:
            names = batch.column("s").to_numpy()
            for at, words, sizes in _sets(batch):
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((words, rarity[words & (COUNTERS - 1)], owner))
                words, place = words[order], np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                mixed = _mix(words ^ np.int64(0x5DEECE66D))
                scale = np.floor(np.log(sizes) / step).astype(np.int64) & 63
                for role, (kind, m, x, take) in enumerate(heads(sizes, threshold)):
                    kept = place < take[owner]
                    w, o = mixed[kept], owner[kept]
                    room = np.ceil(256 * (1 + (m[o] + x[o] - 1 - place[kept]) / sizes[o]) + 1e-6).clip(0, 255).astype(np.int64)
                    at_bin = (w >> np.uint64(16)) % np.maximum(m, 1)[o].astype(np.uint64)
                    order = np.lexsort((place[kept], at_bin, o))
                    w, o, at_bin, room, salt = w[order], o[order], at_bin[order], room[order], _mix(kind + 1)
                    one = m[o] == 0
                    out, whose, last = [_mix(w[one] + salt[o[one]])], [o[one]], [room[one]]
                    i, d = np.flatnonzero(~one), 1
                    while len(i):
                        i = i[i + d < len(w)]
                        i = i[(o[i] == o[i + d]) & (at_bin[i] == at_bin[i + d])]
                        out.append(_mix(_mix(w[i] + salt[o[i]]) + w[i + d]))
                        whose.append(o[i])
                        last.append(room[i + d])
                        d += 1
                    whose = np.concatenate(whose)
                    key = np.concatenate(out).astype(np.int64) & ~0xFFFF | scale[whose] << 10 | (x[whose] == 1).astype(np.int64) << 9 | np.concatenate(last) << 1 | role
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(names[at + whose])], names=["key", "s"])

    return run


def _step(threshold: float) -> float:
    return -np.log(threshold) / STEPS if threshold < 1 else 1.0


def _may(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two sets with a key in common may reach the threshold by it, from the ends of their keys; when in doubt, yes.

    One at least is in its own class, the sizes are near enough, and both words are among the n - k + j + x rarest by the k
    that holds for these two sizes: the first j + x shared words make x keys, so that one with a later word isn't needed.
    """
    apart = ((x >> 10 & 63) - (y >> 10 & 63) + 32 & 63) - 32  # logarithm of sizes in steps, modulo 64
    step = _step(threshold)
    ok = (x & y & 1 == 0) & (np.abs(apart) <= STEPS + 1)
    for z, d in ((x, -apart), (y, apart)):  # d: by how many steps the other one is larger, one less to be safe
        room = z >> 1 & 255
        ok &= (room == 255) | (room / 256 >= threshold / (1 + threshold) * (1 + np.exp((d - 1) * step)) - 1e-6)
    return ok


def meet(threshold: float):
    """Pairs a < b of rows whose keys are equal but for their ends, from rows in order of key; the sum of shared is SHARED or more for similar sets."""

    def run(batches):
        key = s = np.zeros(0, np.int64)
        for batch in _ended(batches):
            if batch is not None:
                key, s = np.concatenate([key, batch.column("key").to_numpy()]), np.concatenate([s, batch.column("s").to_numpy()])
                end = int(np.searchsorted(key, key[-1] & ~0xFFFF)) if len(key) else 0  # the last key may go on
            else:
                end = len(key)
            k, x, key, s = key[:end], s[:end], key[end:], s[end:]
            order = np.lexsort((k, x, k >> 16))
            k, x = k[order], x[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])  # copies
            k, x = k[new], x[new]
            i, d = np.arange(len(k)), 1
            while len(i):
                i = i[i + d < len(k)]
                i = i[k[i] >> 16 == k[i + d] >> 16]
                for at in range(0, len(i), ROWS):
                    j = i[at : at + ROWS]
                    j = j[(x[j] != x[j + d]) & _may(k[j], k[j + d], threshold)]
                    yield pa.RecordBatch.from_arrays([pa.array(x[j]), pa.array(x[j + d]), pa.array(np.where(k[j] & 512, SHARED, 1))], names=["a", "b", "shared"])
                d += 1

    return run


def _ended(batches):
    yield from batches
    yield None


def mark(batches):
    """Bits of the sets of a partition's pairs."""
    bits = np.zeros(MARKS, bool)
    for batch in batches:
        for name in ("a", "b"):
            bits[batch.column(name).to_numpy() & (MARKS - 1)] = True
    parts = [x.tobytes() for x in np.packbits(bits).reshape(CHUNKS, -1)]
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "bits"])


def either(pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]])
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [out.tobytes()]})


def marks(rows) -> bytes:
    return b"".join(r["bits"] for r in sorted(rows, key=lambda r: r["chunk"])) or bytes(MARKS // 8)


def marked(held):
    """Sets that may be in a pair."""

    def run(batches):
        bits = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column("s").to_numpy() & (MARKS - 1)]))

    return run


def compare(threshold: float):
    """Similarities of a cell's pairs that reach the threshold."""

    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        out, where = [], {}
        for i, s in enumerate(sets["s"]):
            where.setdefault(s, []).append(i)  # more than one, if the first hashes of sets are equal
        words, second = list(sets["words"]), sets["s2"].to_numpy()
        size = np.array([len(x) for x in words], np.int64)
        for a, others in pairs.groupby("a")["b"]:
            at = [(b, i) for b in others for i in where[b]]
            for i in where[a]:
                for k in range(0, len(at), 2_000):
                    part = at[k : k + 2_000]
                    own, theirs = np.sort(words[i]), np.concatenate([words[j] for _, j in part])
                    n = size[[j for _, j in part]]
                    found = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                    shared = np.add.reduceat((own[found] == theirs).astype(np.int64), np.cumsum(n) - n)
                    near = shared / (len(own) + n - shared)
                    out += [(a, second[i], part[x][0], second[part[x][1]], near[x]) for x in np.flatnonzero(near >= threshold)]
        return pd.DataFrame(out, columns=["a", "a2", "b", "b2", "jaccard"])

    return run

"""Whole-batch word views of texts, in numpy.

A word is a run of characters other than the six ASCII white-space characters
(space, tab, line feed, vertical tab, form feed, carriage return). A batch of
texts becomes one array of code points; word bounds, the text each word lies
in and a 64-bit hash for each word come from array operations, without a Python
object for each word. Batches are cut by characters, so memory is bounded by
the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INV_BASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_CHARS = 400_000
_ODD = np.array([(0xA24BAED4963EE407 * (2 * i + 1)) % (1 << 64) | 1 for i in range(64)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INV_BASE)):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def forget() -> None:
    """Drops the tables of powers."""
    _POWERS.update(up=np.ones(1, U), down=np.ones(1, U))


def code_points(texts: list[str]) -> np.ndarray:
    """All characters of the texts, one after another."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span codes[start:end], equal for equal content."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], out=sums[1:])
    body = (sums[ends] - sums[starts]) * down[starts]
    return mix(body + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Batch:
    """Words of some texts. first[i]:first[i + 1] are the words of text i."""

    codes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None


def batch(texts: list[str], hashed: bool = True) -> Batch:
    """Word bounds (offsets into all code points) and hashes of a list of texts."""
    codes = code_points(texts)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=bounds[1:])
    inside = (codes != 32) & ((codes < 9) | (codes > 13))
    edge = np.zeros(len(codes) + 1, bool)
    edge[bounds] = True  # a word ends where its text ends
    before = np.zeros(len(codes) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(codes) + 1, bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    owner = np.searchsorted(bounds, starts, side="right") - 1
    first = np.searchsorted(starts, bounds)
    return Batch(codes, bounds, starts, ends, owner, first, span_hashes(codes, starts, ends) if hashed else None)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `limit` characters together; a longer text stands alone."""
    begin = size = 0
    for i, x in enumerate(texts):
        if i > begin and size + len(x) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(x)
    if begin < len(texts):
        yield begin, len(texts)


def windows(b: Batch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words inside one text, and the index of its first word."""
    k = len(b.starts) - n + 1
    if k <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(b.owner[:k] == b.owner[n - 1 :])
    h = np.full(len(at), n, U)
    for i in range(n):
        h += b.hashes[at + i] * _ODD[i % len(_ODD)]
        h *= U(0x2545F4914F6CDD1D)
    return mix(h), at


_FOLDED = 0x3000
_LOWER = np.arange(_FOLDED, dtype=np.uint32)
_ALNUM = np.zeros(_FOLDED, bool)
_CLASS = np.zeros(_FOLDED, np.uint8)  # 1 upper, 2 other letter, 3 digit, 0 anything else
for _i in range(_FOLDED):
    _c = chr(_i)
    if len(_c.lower()) == 1:
        _LOWER[_i] = ord(_c.lower())
    _ALNUM[_i] = _c.isalnum()
    _CLASS[_i] = 1 if _c.isupper() else 2 if _c.isalpha() else 3 if _c.isdigit() else 0


def fold(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points and their classes. Code points from U+3000 on count as letters."""
    near = codes < _FOLDED
    safe = np.where(near, codes, 0)
    return np.where(near, _LOWER[safe], codes), np.where(near, _CLASS[safe], 2)


def cores(b: Batch, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's bounds without leading and trailing signs; empty (start = end) for a word of signs only."""
    solid = np.flatnonzero(kinds > 0)
    if not len(solid):
        return b.starts.copy(), b.starts.copy()
    i = np.searchsorted(solid, b.starts)
    j = np.searchsorted(solid, b.ends) - 1
    some = i <= j
    start = np.where(some, solid[np.minimum(i, len(solid) - 1)], b.starts)
    end = np.where(some, solid[np.maximum(j, 0)] + 1, b.starts)
    return start, end

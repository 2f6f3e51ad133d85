"""Encoding of whole texts with public tokenizers, one encoding for each different word.

Both tokenizers cut a text into pieces at white space before merging, so a
text's ids are the ids of its words in order. A batch of texts becomes one array
of code points; words are hashed twice (128 bits together) by array operations
and looked up in a bounded table of ids, so that Python handles only words not
seen before. Strings of special tokens in a text get their special ids, as in a
plain call of the library. Callers pass batches of a few million characters at
most, or one long text.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import islice

import numpy as np

from . import words

#: White space as the tokenizers' patterns take it (fixed values: Unicode White_Space).
_WS = r"\t-\r \x85\xa0  -     　"
#: Letters after which a comma or full stop at a word's end always begins a piece of its own.
_A = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A byte-level piece: letters, or another run, with at most one space before it, or white space.
_BYTE_PIECES = re.compile(rf" ?[{_A}]++(?![^,.{_WS}]|[,.][^{_WS}])|(?<=[{_A}])[,.](?![^{_WS}])| ?[^{_WS}]++|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: The word tokenizer drops white space.
_WORD_PIECES = re.compile(rf"[{_A}]++(?![^,.\t-\r ]|[,.][^\t-\r ])|(?<=[{_A}])[,.](?![^\t-\r ])|[^\t-\r ]++")
_LETTERS = re.compile(f"[{_A}]+")
#: Both tokenizers cut between letters and signs; an apostrophe may begin an ending.
_SIGNS_LAST = re.compile(rf"([{_A}]+)([!-&(-/:-@\[-`{{-~]+)")
#: How byte-level models write bytes: printable ones as they are, the others from code 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTED)))}
_MAX_KEPT, _MAX_IDS = 2_000_000, 16_000_000
_MAX_PIECES, _LONG_PIECE = 200_000, 200
_GROUP = 500
#: Characters that go through the arrays at once.
_CHUNK = 400_000
#: What a character is: 1 white space between words, 2 any other white space, 4 a letter of _A, 8 an ASCII sign but the apostrophe.
_SPACE, _ODD, _LETTER, _SIGN = 1, 2, 4, 8


def _kinds(between: str) -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    out[[i for i in range(0x3001) if re.match(rf"[{_WS}]", chr(i))]] = _ODD
    out[[ord(c) for c in between]] = _SPACE
    out[[i for i in range(256) if re.match(f"[{_A}]", chr(i))]] = _LETTER
    out[[i for i in range(33, 127) if not chr(i).isalnum() and i != 39]] = _SIGN
    return out


_MIXED = words.mix(np.arange(1, 2049)).reshape(2, 1024)


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each span and its kind."""
    up, down = words.powers(len(codes) + 1)
    low, high, out = codes & np.uint32(1023), (codes >> np.uint32(10)).astype(np.uint64), []
    plain = not high.any()
    tail = (ends - starts).astype(np.uint64) * np.uint64(8) + kind.astype(np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    for i in (0, 1):
        value = _MIXED[i][low]
        if not plain:
            value += high * _MIXED[1 - i][0]
        value *= up[: len(codes)]
        np.cumsum(value, out=sums[1:])
        out.append(words.mix((sums[ends] - sums[starts]) * down[starts] + tail * _MIXED[i][1]))
    return out


class Table:
    """Ids by two hashes: open addressing in arrays, in order of entry."""

    def __init__(self):
        self.n = self.used = 0
        self.slots = np.full(1 << 12, -1, np.int32)
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out, mask = np.full(len(key), -1, np.int32), np.uint64(len(self.slots) - 1)
        if not self.n:
            return out
        todo, place = None, key & mask
        while True:
            entry = self.slots[place]
            same = (self.key[entry] == key) & (self.check[entry] == check) & (entry >= 0)
            if todo is None:
                out[same] = entry[same]
            else:
                out[todo[same]] = entry[same]
            on = np.flatnonzero((entry >= 0) & ~same)
            if not len(on):
                return out
            todo = on if todo is None else todo[on]
            key, check, place = key[on], check[on], (place[on] + np.uint64(1)) & mask

    def _place(self, first: int) -> None:
        mask = np.uint64(len(self.slots) - 1)
        entry = np.arange(first, self.n, dtype=np.int32)
        place = self.key[entry] & mask
        while len(entry):
            free = self.slots[place] < 0
            self.slots[place[free]] = entry[free]
            on = self.slots[place] != entry
            entry, place = entry[on], (place[on] + np.uint64(1)) & mask

    def add(self, key: np.ndarray, check: np.ndarray, data: list[bytes]) -> None:
        """Adds keys that are different and not there yet."""
        size = np.array([len(x) // 4 for x in data], np.int64)
        ids, n = np.frombuffer(b"".join(data), "<u4"), self.n + len(key)
        room = lambda a, most: a if len(a) >= most else np.concatenate((a, np.zeros(max(most, 2 * len(a)) - len(a), a.dtype)))
        for name, new in (("key", key), ("check", check), ("size", size), ("at", self.used + np.cumsum(size) - size)):
            held = room(getattr(self, name), n)
            held[self.n : n] = new
            setattr(self, name, held)
        self.ids = room(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        first, self.n, self.used = self.n, n, self.used + len(ids)
        if 2 * n > len(self.slots):
            self.slots, first = np.full(1 << (4 * n - 1).bit_length(), -1, np.int32), 0
        self._place(first)

    def shrink(self) -> None:
        """Keeps the older half, which holds the commonest words."""
        self.n //= 2
        self.used = int(self.at[self.n]) if self.n else 0
        self.key, self.check, self.size, self.at, self.ids = self.key[: self.n].copy(), self.check[: self.n].copy(), self.size[: self.n].copy(), self.at[: self.n].copy(), self.ids[: self.used].copy()
        self.slots.fill(-1)
        self._place(0)
#: Callers cut their batches into this many characters; larger ones look up fewer pieces twice.
BATCH_CHARS = 6_000_000


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids. `path` is the tokenizer's file.

    A key is a word that follows a space, or "\\n" and a word (with a byte-level
    tokenizer both are encoded), or "\\t" and a piece that stands for itself.
    A byte-level tokenizer's text that has other white space than single spaces
    and line feeds between words is cut by `pieces`, and its pieces are kept in a dictionary.
    """

    def __init__(self, path: str, pieces: re.Pattern, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.pieces, self.spaced = pieces, spaced
        self.model = Tokenizer.from_file(path)
        special = {x.content: i for i, x in self.model.get_added_tokens_decoder().items()}
        self.special = {x: i.to_bytes(4, "little") for x, i in special.items()}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(special, key=len, reverse=True)))})") if special else None
        self.model.encode_special_tokens = True  # their strings are found before; within a piece they are ordinary text
        # A mark between words, so that many go in one call. It has one id, which no text without it has.
        self.mark, self.within = ("\n", "<|endoftext|>") if spaced else (" | ", "|")
        (self.mark_id,) = self.model.encode(self.mark, add_special_tokens=False).ids
        self.line = self.mark_id.to_bytes(4, "little") if spaced else b""
        self.kinds = _kinds(" \n" if spaced else "\t\n\v\f\r ")
        self.table = Table()
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, encoded alone."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> list[bytes]:
        """The ids of different keys. Words of Latin letters go to the tokenizer's merges directly."""
        merge, after, spaced, line = self.model.model.tokenize, " ".translate(_BYTES) if self.spaced else "", self.spaced, self.line
        known, apart, plain, flat, direct, sizes = {}, [], [], [], [], []
        for k in keys:
            lead = k[0] if spaced and k[0] in "\t\n" else ""
            x = k[1:] if lead else k
            if x.isascii() and x.isalpha() and (spaced or x.islower()):
                flat += [t.id for t in merge(x if lead else after + x)]
            elif _LETTERS.fullmatch(x) and (spaced or x.islower()):
                x = x.encode().decode("latin-1").translate(_BYTES)
                flat += [t.id for t in merge(x if lead else after + x)]
            else:
                (apart if self.within in x or x.isspace() else plain).append((k, x if lead or not spaced else f" {x}"))
                continue
            direct.append(k)
            sizes.append(len(flat))
        data = np.array(flat, "<u4").tobytes()
        known = {k: data[4 * i : 4 * j] if not spaced or k[0] != "\n" else line + data[4 * i : 4 * j] for k, i, j in zip(direct, [0, *sizes], sizes)}
        done = list(zip(apart, self._ids([x for _, x in apart]))) if apart else []
        for i in range(0, len(plain), _GROUP):
            group = plain[i : i + _GROUP]
            ids = np.array(self.model.encode_batch_fast([self.mark.join([x for _, x in group])], add_special_tokens=False)[0].ids, "<u4")
            at = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(at) == len(group) + 1:
                data = ids.tobytes()
                done += [(x, data[4 * i + 4 : 4 * j]) for x, i, j in zip(group, at, at[1:])]
            else:
                done += zip(group, self._ids([x for _, x in group]))
        known.update((k, line + v if spaced and k[0] == "\n" else v) for (k, _), v in done)
        return [known[k] for k in keys]

    def _odd(self, text: str) -> bytes:
        """The ids of a text of a byte-level tokenizer, piece by piece."""
        keys = ["\t\n", *(x[1:] if x[0] == " " and not x.isspace() else "\t" + x for x in self.pieces.findall(text))]
        new = list({x for x in keys if x not in self.known})
        if len(self.known) + len(new) > _MAX_PIECES:  # the oldest are the commonest
            self.known = dict(islice(self.known.items(), _MAX_PIECES // 2))
            new = list({x for x in keys if x not in self.known})
        self.known.update(zip(new, self._learn(new)))
        out = b"".join([self.known[x] for x in keys])[len(self.line) :]
        for x in new:
            if len(x) > _LONG_PIECE:
                del self.known[x]
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts by words; those of other white space by pieces."""
        codes = words.code_points(texts)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=bounds[1:])
        kind = self.kinds[codes]
        gap = kind == _SPACE
        edge = np.ones(len(codes) + 1, bool)
        edge[1:-1] = False
        edge[bounds] = True
        before, after = np.zeros(len(codes) + 1, bool), np.zeros(len(codes) + 1, bool)
        before[1:], after[:-1] = ~gap, ~gap
        odd = np.zeros(len(texts), bool)
        if self.spaced:
            bad = kind == _ODD
            bad |= gap & (~before[:-1] | edge[:-1] | ~after[1:] | edge[1:])
            if bad.any():
                odd[np.unique(np.searchsorted(bounds, np.flatnonzero(bad), side="right") - 1)] = True
        starts, ends = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
        owner = np.searchsorted(bounds, starts, side="right") - 1
        lead = np.zeros(len(starts), np.int64)
        if self.spaced:
            if odd.any():
                use = ~odd[owner]
                starts, ends, owner, lead = starts[use], ends[use], owner[use], lead[use]
            lead[(codes[np.maximum(starts, 1) - 1] == 10) | edge[starts]] = 1
        # letters and the signs after them, which no tokenizer merges, are two spans
        stop = np.flatnonzero((kind & _LETTER) == 0)
        stop = np.append(stop, len(codes))
        core = np.minimum(stop[np.searchsorted(stop, starts)], ends)
        signs = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(kind == _SIGN, out=signs[1:])
        two = (core > starts) & (core < ends) & (signs[ends] - signs[core] == ends - core)
        head = np.arange(len(starts)) + np.cumsum(two) - two
        n = len(starts) + int(two.sum())
        begin, end, what, whose = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, 2 * self.spaced), np.empty(n, np.int64)
        begin[head], end[head], what[head], whose[head] = starts, np.where(two, core, ends), lead, owner
        begin[head[two] + 1], end[head[two] + 1], whose[head[two] + 1] = core[two], ends[two], owner[two]
        key, check = _hashes(codes, begin, end, what)
        entry = self.table.find(key, check)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            if self.table.n + len(lost) > _MAX_KEPT or self.table.used > _MAX_IDS:
                self.table.shrink()
                entry = self.table.find(key, check)
                lost = np.flatnonzero(entry < 0)
            _, first = np.unique(key[lost], return_index=True)
            first = lost[first]
            whole, marks = "".join(texts), ["", "\n", "\t"]
            self.table.add(key[first], check[first], self._learn([marks[w] + whole[i:j] for w, i, j in zip(what[first].tolist(), begin[first].tolist(), end[first].tolist())]))
            entry[lost] = self.table.find(key[lost], check[lost])
        size, at = self.table.size[entry], self.table.at[entry]
        spans = np.searchsorted(whose, np.arange(len(texts) + 1))
        if self.spaced:  # the first word has no line feed before it
            first = spans[:-1][spans[1:] > spans[:-1]]
            size[first] -= 1
            at[first] += 1
        upto = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        data = self.table.ids[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])].astype("<u4").tobytes()
        cuts = (4 * upto[spans]).tolist()
        out = [data[i:j] for i, j in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._odd(texts[i])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        rows, parts = [], []
        for i, text in enumerate(texts):
            if self.cut is not None and "<" in text and len(pieces := self.cut.split(text)) > 1:
                ids = self.encode(pieces[::2])
                out[i] = ids[0] + b"".join([self.special[x] + y for x, y in zip(pieces[1::2], ids[1:])])
            else:
                rows.append(i)
                parts.append(text if self.spaced else _lowered(text))
        for lo, hi in words.chunks(parts, _CHUNK):
            for i, data in zip(rows[lo:hi], self._plain(parts[lo:hi])):
                out[i] = data
        return out


def _lowered(text: str) -> str:
    """Lower case where that can't differ from the tokenizer's own (Latin-1), else the text as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


_LOADED: dict[tuple[str, bool], Encoder] = {}


def _load(path: str, pieces: re.Pattern, spaced: bool) -> Encoder:
    if (path, spaced) not in _LOADED:
        _LOADED[path, spaced] = Encoder(path, pieces, spaced)
    return _LOADED[path, spaced]


def byte_encoder(path: str) -> Encoder:
    """Byte-level BPE; one encoder for each worker process."""
    return _load(path, _BYTE_PIECES, True)


def word_encoder(path: str) -> Encoder:
    """BPE over lower-case words; one encoder for each worker process."""
    return _load(path, _WORD_PIECES, False)

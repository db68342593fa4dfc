"""Token ids of whole texts by a byte-level BPE of the ``tokenizers`` library.

The pre-tokens of a text are found with array operations over its code points;
each distinct pre-token is encoded once by the library and kept in a bounded
cache of the worker process, as long as its tasks encode.  Texts with code points outside the well-settled
letter and digit ranges go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from . import textops as X

U64 = np.uint64
#: distinct pre-tokens that a worker keeps
CACHE = 1_500_000
#: pre-tokens given to the library at once: what it returns of each is large
AT_ONCE = 4096
#: bytes of text that are encoded at once, but one row at least
SLICE_BYTES = 1 << 18
#: of tasks that go on with the encoder of the one before
KIND = "tokens"

_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: code points whose classes are the same in every Unicode version of the last years
_SETTLED = [(0, 0x530), (0x621, 0x64B), (0x905, 0x93A), (0x1E00, 0x2000), (0x2000, 0x2040), (0x20AC, 0x20AD), (0x3000, 0x3003), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFF01, 0xFF5F)]
_LETTER, _DIGIT, _OTHER, _SPACE = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(65536, 9, np.uint8)
    for a, b in _SETTLED:
        for c in range(a, b):
            kind = unicodedata.category(chr(c))
            if kind != "Cn":
                out[c] = _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _OTHER
    out[_SPACES] = _SPACE
    return out


_CLASS: np.ndarray | None = None


def pre_tokens(cp: np.ndarray, kind: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Start flags of pre-tokens: contractions, runs of letters, digits or others
    with one space before them, and white space without the character that precedes a word."""
    n = len(cp)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    start = change.copy()
    space = kind == _SPACE
    # a run of white space that something follows in its text gives up its last character
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    at = np.flatnonzero(last)
    start[at] = True
    # which, being a space, opens the next token
    joined = at[cp[at] == 0x20]
    start[joined + 1] = False
    # contractions open where an apostrophe does, without a space before it
    a = np.flatnonzero((cp == 0x27) & start)
    a = a[a + 1 < n]
    a = a[(kind[a + 1] == _LETTER) & ~first[a + 1]]
    if len(a):
        x = cp[a + 1]
        y = np.where((a + 2 < n), cp[np.minimum(a + 2, n - 1)], 0)
        y[first[np.minimum(a + 2, n)]] = 0
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        size = np.where(one, 2, np.where(two, 3, 0))
        a, size = a[size > 0], size[size > 0]
        start[a + 1] = False
        after = a + size
        start[after[after < n]] = True
    return start


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        global _CLASS
        if _CLASS is None:
            _CLASS = _classes()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self._clear()

    def _clear(self):
        self.keys = [np.empty(0, U64), np.empty(0, U64)]  # settled, recent
        self.at = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.size = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.ids = np.empty(0, np.uint32)
        self.used = 0

    def _store(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        size = np.array([len(x) for x in ids], np.int32)
        flat = np.fromiter((y for x in ids for y in x), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(flat), self.used, 1 << 16), np.uint32)])
        at = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        for level in (1, 0):
            k = np.concatenate([self.keys[level], keys])
            order = np.argsort(k, kind="stable")
            self.keys[level], self.at[level], self.size[level] = k[order], np.concatenate([self.at[level], at])[order], np.concatenate([self.size[level], size])[order]
            if level == 1 and len(self.keys[1]) < max(1 << 14, len(self.keys[0]) // 8):
                return
            if level == 1:
                keys, at, size = self.keys[1], self.at[1], self.size[1]
                self.keys[1], self.at[1], self.size[1] = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(keys), -1, np.int64)
        size = np.zeros(len(keys), np.int32)
        for level in (0, 1):
            p = X.lookup(self.keys[level], keys)
            ok = p >= 0
            at[ok], size[ok] = self.at[level][p[ok]], self.size[level][p[ok]]
        return at, size

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets)."""
        rows = len(offs) - 1
        text = buf.tobytes().decode()
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        co = lead[offs]
        wide = cp > 0xFFFF
        kind = _CLASS[np.where(wide, 0, cp)]
        odd_char = wide | (kind == 9)
        odd = np.zeros(rows, dtype=bool)
        if odd_char.any():
            odd[np.searchsorted(co, np.flatnonzero(odd_char), side="right") - 1] = True
        ids, size = np.empty(0, np.uint32), np.zeros(rows, np.int64)
        if len(cp):
            start = np.flatnonzero(pre_tokens(cp, kind, co))
            end = np.append(start[1:], len(cp))
            row = np.searchsorted(co, start, side="right") - 1
            if odd.any():
                ok = ~odd[row]
                start, end, row = start[ok], end[ok], row[ok]
            up, down = X.powers(len(cp) + 1)
            s = np.zeros(len(cp) + 1, U64)
            np.cumsum(X.mix(cp.astype(U64) + U64(1)) * up[: len(cp)], out=s[1:])
            h = X.mix((s[end] - s[start]) * down[start] + (end - start).astype(U64))
            del s
            unique, one, back = np.unique(h, return_index=True, return_inverse=True)
            if len(self.keys[0]) + len(self.keys[1]) + len(unique) > CACHE:
                self._clear()
            at, n = self._find(unique)
            new = np.flatnonzero(at < 0)
            if len(new):
                words = [text[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist())]
                self._store(unique[new], [x.ids for i in range(0, len(words), AT_ONCE) for x in self.library.encode_batch_fast(words[i : i + AT_ONCE], add_special_tokens=False)])
                at, n = self._find(unique)
            n = n[back].astype(np.int64)
            ids = self.ids[X.ranges(at[back], n)]
            size = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
        if odd.any():
            base = np.cumsum(size) - size
            parts = []
            for r in range(rows):
                if odd[r]:
                    x = np.array(self.library.encode(text[co[r] : co[r + 1]], add_special_tokens=False).ids, np.uint32)
                    parts.append(x)
                    size[r] = len(x)
                else:
                    parts.append(ids[base[r] : base[r] + size[r]])
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(size)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, which stays until a task of another kind comes."""
    if path not in _encoders:
        # a task has one core, and each thread of the library would keep memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
        X.leave(KIND, _encoders.clear)
    return _encoders[path]

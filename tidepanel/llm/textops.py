"""Vectorised text primitives shared by the operators of this subpackage.

Texts are handled as UTF-8 byte buffers with row offsets, as Arrow delivers
them.  Every function works on whole rows; long inputs are processed in slices
of a bounded number of bytes, and a row is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: words are runs of everything but ASCII white space
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: words are runs of ASCII letters, digits and every byte of a non-ASCII character
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = np.atleast_1d(np.asarray(x, dtype=U64))  # arrays wrap around silently
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow = {"n": 0, "up": np.empty(0, U64), "down": np.empty(0, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if _pow["n"] < n:
        size = max(n, 1 << 16)
        for name, b in (("up", _BASE), ("down", _INV)):
            a = np.full(size, U64(b), dtype=U64)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
        _pow["n"] = size
    return _pow["up"][:n], _pow["down"][:n]


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give memory back: Spark keeps a finished task's worker process, and all that it holds."""
    _pow.update(n=0, up=np.empty(0, U64), down=np.empty(0, U64))
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


#: what tasks leave in their worker process for the next of their kind, by that kind, and how to drop it
_left: dict[str, object] = {}


def leave(kind: str, drop) -> None:
    _left[kind] = drop


def drop_left(keeps: str | None = None) -> None:
    """Drop what tasks of other kinds left in this worker process."""
    for kind in [x for x in _left if x != keeps]:
        _left.pop(kind)()


def tidy(run, *shared, keeps: str | None = None):
    """A mapInArrow function that releases its memory, and the broadcast values ``shared``, when its task ends.

    What tasks of another kind than ``keeps`` left in the worker goes before it begins.
    """

    def tidied(batches):
        drop_left(keeps)
        try:
            yield from run(batches)
        finally:
            for x in shared:
                x.__dict__.pop("_value", None)  # read again from its file by the next task
            release()

    return tidied


def tidy_group(run, least: int = 1 << 20):
    """An applyInArrow function that releases its memory after groups of at least so many bytes."""

    def tidied(*groups):
        drop_left()
        out = run(*groups)
        if sum(g.nbytes for g in groups) >= least:
            release()
        return out

    # the number of arguments tells Spark what it is called with
    return (lambda group: tidied(group)) if run.__code__.co_argcount == 1 else (lambda left, right: tidied(left, right))


def column(batch: pa.RecordBatch, name_or_index) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    col = batch.column(name_or_index)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, but of one row at least."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return _LOWER[buf]


class Words:
    """Words of consecutive rows: byte ranges, rows and 64-bit hashes."""

    __slots__ = ("start", "end", "row", "hash", "rows", "first", "offs")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = SPACED):
        self.rows, self.offs = len(offs) - 1, offs
        buf = lower(buf)
        w = is_word[buf]
        n = len(buf)
        if n:
            cut = np.zeros(n + 1, dtype=bool)
            cut[offs] = True
            before = np.empty(n, dtype=bool)
            before[0] = False
            before[1:] = w[:-1]
            after = np.empty(n, dtype=bool)
            after[-1] = False
            after[:-1] = w[1:]
            self.start = np.flatnonzero(w & (~before | cut[:-1]))
            self.end = np.flatnonzero(w & (~after | cut[1:])) + 1
            self.hash = span_hash(buf, self.start, self.end)
        else:
            self.start = self.end = np.empty(0, np.int64)
            self.hash = np.empty(0, U64)
        self.first = np.searchsorted(self.start, offs).astype(np.int64)
        self.first[-1] = len(self.start)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial byte hash; one entry longer than ``buf``."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, the same for the same bytes anywhere."""
    s = prefix_hash(buf)
    _, down = powers(len(buf) + 1)
    return mix((s[end] - s[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def chain(*hashes: np.ndarray) -> np.ndarray:
    """Order-dependent combination of equally long hash vectors."""
    x = hashes[0]
    for h in hashes[1:]:
        x = mix(x * U64(0x2545F4914F6CDD1D) + h)
    return x


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of distinct k-word shingles, in order of row and hash.

    A row with fewer than k words, but not none, has its whole sequence as one.
    """
    h, first = words.hash, words.first
    counts = np.diff(first)
    n = len(h)
    if n >= k:
        x = chain(*(h[i : n - k + 1 + i] for i in range(k)))
        row = words.row[: n - k + 1]
        ok = words.row[k - 1 :] == row
        x, row = x[ok], row[ok]
    else:
        x, row = np.empty(0, U64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at, left = first[short], counts[short]
        y = mix(h[at] + U64(0x632BE59BD9B4E019))
        for i in range(1, k - 1):
            more = left > i
            y[more] = mix(y[more] * U64(0x2545F4914F6CDD1D) + h[at[more] + i] + U64(1))
        x, row = np.concatenate([x, y]), np.concatenate([row, short])
    order = by_row(row, x, words.rows)
    x, row = x[order], row[order]
    if len(x):
        keep = np.empty(len(x), dtype=bool)
        keep[0] = True
        keep[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
        x, row = x[keep], row[keep]
    return row, x


def by_row(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """Order of (row, key); the row numbers are radix sorted where they are small."""
    order = np.argsort(key)
    small = row[order].astype(np.uint16) if rows <= 1 << 16 else row[order]
    return order[np.argsort(small, kind="stable")]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., for each start its length numbers."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) - np.repeat(ends - length - np.asarray(start, np.int64), length)


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)

"""Packed shuffles: sorted uint64 arrays travel as one binary row a shard and flush.

A map task keeps arrays of (key, value) and, when they reach a bounded size,
emits one row a shard of the key space.  Shards are many small ranges of keys
whose number follows spark.sql.shuffle.partitions, so a reduce group stays
small at any input size; what one key can add to a shard is bounded by the
callers' pre-aggregation in each flush.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Range shards over the whole 64-bit key space."""
    return (((keys >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


def cuts(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of each shard within sorted keys."""
    return np.searchsorted(shard_of(sorted_keys, shards), np.arange(shards + 1))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, each with its length before it."""
    return b"".join(np.array([len(a)], np.int64).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob, kinds) -> list[np.ndarray]:
    out, at = [], 0
    view = memoryview(blob)
    for kind in kinds:
        n = int(np.frombuffer(view[at : at + 8], np.int64)[0])
        out.append(np.frombuffer(view[at + 8 : at + 8 + 8 * n], kind))
        at += 8 + 8 * n
    return out


def squeeze(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def swell(blob, kind) -> np.ndarray:
    view = memoryview(blob)
    n = int(np.frombuffer(view[:8], np.int64)[0])
    return np.frombuffer(pa.decompress(pa.py_buffer(view[8:]), n, "zstd", asbytes=True), kind)


def deltas(a: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, which compress."""
    return np.diff(a, prepend=a.dtype.type(0))


def rows(shard: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], names=["shard", "blob"])


SCHEMA = "shard int, blob binary"

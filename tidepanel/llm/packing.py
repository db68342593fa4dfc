"""Best-fit packing by a linear grouping scheme.

Documents are tokenised, an end id is appended, and longer ones are cut into
full pieces after a first that may be shorter.  Packing needs only how many
pieces of each length there are, at most ``size`` numbers at any input size:

* large lengths, in descending order, are dealt into groups of equal
  cardinality and rounded up to the largest of their group;
* configurations of rounded lengths are optimised by column generation (the
  linear relaxation of cutting stock, priced by a knapsack), and rounded down;
* actual lengths take the places of the rounded ones, which leaves room;
* what the configurations left, and then the small lengths, go best-fit into the
  room, and at last into sequences of their own.

The plan is a short list of patterns with multiplicities.  A piece finds its
sequence and offset by its rank among the pieces of its length, and ranks come
from counts a task, so no task sees more than its own pieces.

Null and empty texts are one piece of the end id alone.  Rows that repeat, and
rows without an id, are packed once each; pieces of one length take their places
in the order of tasks and rows.  Texts are taken whole, whatever their length.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime
from . import textops as X
from . import tokens

SIZE = 1024
END_ID = 2
GROUPS = 128
#: lengths up to this part of a sequence are small
SMALL = 1 / 4


def _lp(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation for cutting stock: (configurations as columns, their real multiplicities)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    rest = np.arange(capacity + 1)[None, :] - sizes[:, None]  # room that is left beside an item
    fits, rest = rest >= 0, np.maximum(rest, 0)
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        # unbounded knapsack, an item more with each layer: best value of every capacity, and the item that gives it
        best, layers = np.zeros(capacity + 1), []
        for _ in range(capacity // int(sizes.min())):
            value = np.where(fits, best[rest] + price[:, None], -1.0)
            took = value.argmax(axis=0)
            more = value[took, np.arange(capacity + 1)]
            took[more <= best + 1e-12] = -1
            layers.append(took)
            if (took < 0).all():
                break
            best = np.maximum(best, more)
        if best[capacity] <= 1 + 1e-7:
            break
        column = np.zeros(k)
        c = capacity
        for took in reversed(layers):
            if took[c] >= 0:
                column[took[c]] += 1
                c -= int(sizes[took[c]])
        d = inverse @ column
        ok = d > 1e-10
        ratio = np.full(k, np.inf)
        ratio[ok] = x[ok] / d[ok]
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * d
        x[out] = step
        basis[:, out] = column
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
    return basis, np.maximum(x, 0)


class _Room:
    """Patterns by the room that they have left, each with its multiplicity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by: dict[int, list[list]] = {}
        self.rooms: list[int] = []

    def add(self, lengths: list[int], times: int, room: int | None = None) -> None:
        room = self.capacity - sum(lengths) if room is None else room
        if room not in self.by or not self.by[room]:
            if room not in self.by:
                self.by[room] = []
            bisect.insort(self.rooms, room)
        self.by[room].append([lengths, times])

    def place(self, length: int, count: int) -> None:
        """Best fit: the least sufficient room first; new sequences when none is left."""
        while count:
            i = bisect.bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                if count // each:
                    self.add([length] * each, count // each)
                if count % each:
                    self.add([length] * (count % each), 1)
                return
            room = self.rooms[i]
            lengths, times = self.by[room].pop()
            if not self.by[room]:
                self.rooms.pop(i)
            put = min(times, count)
            if times > put:
                self.add(lengths, times - put, room)
            # as many copies in one sequence as would follow by best fit anyway when it alone has this room
            self.add([*lengths, length], put, room - length)
            count -= put

    def patterns(self) -> list[tuple[list[int], int]]:
        return [(lengths, times) for room in sorted(self.by) for lengths, times in self.by[room]]


def plan(histogram: dict[int, int], capacity: int = SIZE, groups: int = GROUPS, small: float = SMALL) -> list[tuple[list[int], int]]:
    """Patterns (lengths, multiplicity) that use every piece of the histogram exactly once."""
    room = _Room(capacity)
    full = histogram.get(capacity, 0)
    if full:
        room.add([capacity], full)
    large = [(n, c) for n, c in sorted(histogram.items(), reverse=True) if small * capacity < n < capacity and c]
    total = sum(c for _, c in large)
    left: dict[int, int] = {}
    if total:
        # groups of equal cardinality: cumulative bounds over the descending lengths
        k = min(groups, total)
        bounds = [total * i // k for i in range(1, k + 1)]
        members: list[list[list[int]]] = [[]]
        used = 0
        for n, c in large:
            while c:
                put = min(c, bounds[len(members) - 1] - used)
                if put:
                    members[-1].append([n, put])
                    used, c = used + put, c - put
                if used == bounds[len(members) - 1] and len(members) < k:
                    members.append([])
        # groups that share their rounded length are one size
        merged: dict[int, list[list[int]]] = {}
        for m in members:
            if m:
                merged.setdefault(m[0][0], []).extend(m)
        sizes = np.array(list(merged), np.int64)
        runs = list(merged.values())
        demand = np.array([sum(c for _, c in r) for r in runs], float)
        columns, times = _lp(sizes, demand, capacity)
        for j in np.argsort(-times, kind="stable"):
            m = int(times[j] + 1e-9)
            slots = [g for g in range(len(sizes)) for _ in range(int(round(columns[g, j])))]
            while m > 0 and slots:
                # as many copies as the shortest run of equal actual lengths allows
                need: dict[int, int] = {}
                for g in slots:
                    need[g] = need.get(g, 0) + 1
                if any(sum(c for _, c in runs[g]) < q for g, q in need.items()):
                    break
                picks: list[int] = []
                step = m
                for g, q in need.items():
                    if runs[g][0][1] >= q:
                        step = min(step, runs[g][0][1] // q)
                    else:
                        step = 1
                for g, q in need.items():
                    for _ in range(q):
                        while not runs[g][0][1]:
                            runs[g].pop(0)
                        picks.append(runs[g][0][0])
                        runs[g][0][1] -= step
                    while runs[g] and not runs[g][0][1]:
                        runs[g].pop(0)
                room.add(picks, step)
                m -= step
        for r in runs:
            for n, c in r:
                left[n] = left.get(n, 0) + c
    for n, c in sorted(left.items(), reverse=True):
        if c:
            room.place(n, c)
    for n, c in sorted(histogram.items(), reverse=True):
        if n <= small * capacity and c:
            room.place(n, c)
    return room.patterns()


def intervals(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first rank), first sequence, and offset of each run of ranks."""
    rank: dict[int, int] = {}
    keys, first, offset = [], [], []
    number = 0
    for lengths, times in patterns:
        at = 0
        for n in lengths:
            r = rank.get(n, 0)
            keys.append((n << 44) | r)
            first.append(number)
            offset.append(at)
            rank[n] = r + times
            at += n
        number += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(first, np.int64)[order], np.array(offset, np.int64)[order], np.int64(number)


def pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, rank (among its task's pieces of its length), ids."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        enc = tokens.encoder(tokenizer)
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for b in batches:
            buf, offs = X.column(b, 1)
            for i, j in X.slices(offs, tokens.SLICE_BYTES):
                ids, at = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                row, piece, start, length, crc, packed = [], [], [], [], [], []
                for r in range(j - i):
                    own = np.append(ids[at[r] : at[r + 1]], np.uint32(end_id)).astype("<u4")
                    a, z = 0, len(own) % size or min(size, len(own))
                    p = 0
                    while a < len(own):
                        part = own[a:z].tobytes()
                        row.append(i + r)
                        piece.append(p)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(part))
                        packed.append(part if keep_ids else None)
                        a, z, p = z, z + size, p + 1
                n = np.array(length, np.int64)
                order = np.argsort(n, kind="stable")
                s = n[order]
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - np.searchsorted(s, s) + seen[s]
                seen += np.bincount(n, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), task)), pa.array(rank), pa.array(packed, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        X.tidy(run, keeps=tokens.KIND), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint, ids binary"
    )


def pack(docs: DataFrame, tokenizer: str, *, size: int = SIZE, groups: int = GROUPS, small: float = SMALL, **options) -> DataFrame:
    """Every piece with its sequence_id and offset (and its ids, unless keep_ids=False)."""
    spark = docs.sparkSession
    held, _ = runtime.written(pieces(docs, tokenizer, size=size, **options), "pieces")
    counts, _ = runtime.written(held.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    shared = spark.sparkContext.broadcast(intervals(plan(histogram, size, groups, small))[:3])
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = held.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    ranked = ranked.select(*kept, "rank")

    def place(batches):
        keys, first, offset = shared.value
        for b in batches:
            n, r = b.column(3).to_numpy(), b.column(6).to_numpy()
            key = (n << 44) | r
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(first[at] + key - keys[at]), pa.array(offset[at])], names=[*kept, "sequence_id", "offset"])

    kind = docs.schema[options.get("doc_id", "doc_id")].dataType.simpleString()
    return ranked.mapInArrow(X.tidy(place), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, sequence_id bigint, offset bigint")


def report(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    return pack(docs, tokenizer, keep_ids=False, **options).drop("ids")

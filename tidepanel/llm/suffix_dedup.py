"""Removal of repeated byte strings by sharded suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier
in the corpus: in a document with a smaller id, or earlier in the same one.

* Every window of ``length`` bytes has an anchor, the position of its least
  hashed ``GRAM``-byte string, which depends on the window's bytes alone.  Equal
  windows have equal anchors, so only windows whose anchor string occurs twice
  somewhere can repeat.  Documents are packed in bundles once; shards of anchor
  strings count them and answer each bundle which of its own are repeated.
* Picked windows travel, an anchor's neighbouring ones as one snippet of bytes, to the
  shard of their anchor string.  Equal snippets are collapsed, in every slice
  before they travel and again in the shard: all but the first are repeats.
* Where an anchor string has different snippets, a suffix array of them is
  built by Larsson-Sadakane refinement (ranks doubled in depth, groups that are
  single left alone), Kasai's common prefixes cut it into runs of equal
  windows, and all but a run's earliest are repeats.  A shard's snippets are
  taken in blocks of bounded size, each with its own suffix array; an anchor
  string that spans blocks is merged by binary search of its windows in the
  suffix arrays before.
* Marks are merged by document and applied to its bytes.

Null texts are empty.  doc_id is cast to a long; null is the smallest.  Rows of
one doc_id with different texts are in the order of a hash of their texts; rows
that repeat id and text are the same document and are answered alike.  Texts are
taken whole: a row of n bytes takes some 160 n bytes of a worker's memory, also
where it repeats one character.  An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, runtime
from . import textops as X
from .exchange import deltas, squeeze, swell

U64 = np.uint64
LENGTH = 100
GRAM = 24
#: bytes of documents that are packed together
BUNDLE = 1 << 20
#: bytes of snippets in one suffix array, and that are decided together
BLOCK = 1 << 19
#: bytes that are compared at a time
COMPARED = 1 << 20
_POSITION = U64((1 << 30) - 1)


def anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, first window, last window, anchor's string hash)."""
    n = len(buf)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.astype(U64)
    s = X.prefix_hash(buf)
    _, down = X.powers(n + 1)
    g = X.mix((s[GRAM:] - s[:-GRAM]) * down[: n - GRAM + 1])
    del s
    m = (g & ~_POSITION) | np.arange(len(g), dtype=U64)
    span = length - GRAM + 1
    size = 1
    while 2 * size <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < span:
        m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
    at = (m & _POSITION).astype(np.int64)  # of window 0, 1, ...
    windows = np.maximum(np.diff(offs) - length + 1, 0)
    start = X.ranges(offs[:-1], windows)
    row = np.repeat(np.arange(len(windows)), windows)
    if not len(start):
        return empty, empty, empty, empty.astype(U64)
    a = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    # least hashes crowd at the low end: mixed again, they spread over the shards
    return row[first], start[first], start[last], X.mix(g[a[first]] ^ U64(0x9E3779B97F4A7C15))


def bundled(docs: DataFrame) -> DataFrame:
    """(bundle, head, data): slices of documents, packed; docs: doc, tie, text."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            buf_all, offs_all = X.column(b, 2)
            doc, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in X.slices(offs_all, BUNDLE):
                buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
                head = squeeze(np.concatenate([doc[i:j], tie[i:j], offs[1:]]))
                data = np.int64(len(buf)).tobytes() + pa.compress(buf.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) | number]), pa.array([head], pa.binary()), pa.array([data], pa.binary())], names=["bundle", "head", "data"])
                number += 1

    return docs.mapInArrow(X.tidy(run), "bundle bigint, head binary, data binary")


def unbundled(head, data) -> tuple[np.ndarray, ...]:
    """(doc, tie, bytes, offsets) of a bundle."""
    doc, tie, end = swell(head.as_buffer(), np.int64).reshape(3, -1)
    raw = memoryview(data.as_buffer())
    buf = pa.decompress(pa.py_buffer(raw[8:]), int(np.frombuffer(raw[:8], np.int64)[0]), "zstd", asbytes=True)
    return doc, tie, np.frombuffer(buf, np.uint8), np.concatenate([[0], end])


def repeated_anchors(held: DataFrame, length: int, shards: int) -> DataFrame:
    """(bundle, shard, repeated): of a bundle's anchor strings in that shard, which occur at least twice anywhere."""

    def ask(batches):
        for b in batches:
            for bundle, head, data in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                *_, buf, offs = unbundled(head, data)
                h, n = np.unique(anchors(buf, offs, length)[3], return_counts=True)
                at = exchange.cuts(h, shards)
                some = np.flatnonzero(at[1:] > at[:-1])
                cols = [pa.array(some, pa.int32()), pa.array(np.full(len(some), bundle)), *(pa.array([squeeze(f(x[at[s] : at[s + 1]])) for s in some], pa.binary()) for f, x in ((deltas, h), (np.packbits, n > 1)))]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "bundle", "anchors", "again"])

    def answer(group: pa.Table) -> pa.Table:
        h = [np.cumsum(swell(x.as_buffer(), U64), dtype=U64) for x in group.column("anchors")]
        again = [np.unpackbits(swell(x.as_buffer(), np.uint8), count=len(u)).astype(bool) for x, u in zip(group.column("again"), h)]
        _, back, n = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        twice = n > 1
        twice[back[np.concatenate(again)]] = True
        cut = np.cumsum([0, *map(len, h)])
        bits = [squeeze(np.packbits(twice[back[a:z]])) for a, z in zip(cut, cut[1:])]
        return pa.table({"bundle": group.column("bundle"), "shard": group.column("shard"), "repeated": pa.array(bits, pa.binary())})

    asked = held.mapInArrow(X.tidy(ask), "shard int, bundle bigint, anchors binary, again binary")
    return asked.groupBy("shard").applyInArrow(X.tidy_group(answer), "bundle bigint, shard int, repeated binary")


def equal_strings(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = COMPARED) -> np.ndarray:
    """Whether size bytes from a and from b are equal, with at most ``most`` bytes (or one string) laid out at a time.

    Strings that overlap what they are compared with, as in a run of one
    character, have few distances: where many share one, the mismatches at that
    distance are counted once along the text.
    """
    out = np.zeros(len(a), dtype=bool)
    left = np.ones(len(a), dtype=bool)
    gap, back, n = np.unique(a - b, return_inverse=True, return_counts=True)
    for k in np.flatnonzero((gap > 0) & (n * (size.mean() if len(size) else 0) > 4 * len(text))).tolist():
        own = np.flatnonzero(back == k)
        differ = np.zeros(len(text) - int(gap[k]) + 1, np.int64)  # before each position
        np.cumsum(text[gap[k] :] != text[: -gap[k]], out=differ[1:])
        out[own] = differ[b[own] + size[own]] == differ[b[own]]
        left[own] = False
    rest = np.flatnonzero(left)
    total = np.cumsum(size[rest])
    i = 0
    while i < len(rest):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        own = rest[i:j]
        differ = text[X.ranges(a[own], size[own])] != text[X.ranges(b[own], size[own])]
        out[own] = ~np.logical_or.reduceat(differ, np.cumsum(size[own]) - size[own])
        i = j
    return out


def merged_runs(m: np.ndarray) -> np.ndarray:
    """(document, tie, first, last) of windows, runs that follow each other made one."""
    m = m[:, np.lexsort((m[2], m[1], m[0]))]
    if m.shape[1] < 2:
        return m
    new = np.ones(m.shape[1], dtype=bool)
    new[1:] = (m[0, 1:] != m[0, :-1]) | (m[1, 1:] != m[1, :-1]) | (m[2, 1:] > m[3, :-1] + 1)
    at = np.flatnonzero(new)
    return np.stack([*m[:3, at], np.maximum.reduceat(m[3], at)])


def snippets(held: DataFrame, answers: DataFrame, length: int, shards: int) -> DataFrame:
    """(shard, blob, marks): snippets whose anchor strings are repeated, and windows that are repeats already."""

    def pick(own: pa.Table, answered: pa.Table) -> pa.Table:
        doc_all, tie_all, buf, offs = unbundled(own.column("head")[0], own.column("data")[0])
        row, first, last, h = anchors(buf, offs, length)
        known = np.unique(h)
        at, wanted = exchange.cuts(known, shards), [known[:0]]
        for s, bits in zip(answered.column("shard").to_pylist(), answered.column("repeated")):
            u = known[at[s] : at[s + 1]]
            wanted.append(u[np.unpackbits(swell(bits.as_buffer(), np.uint8), count=len(u)).astype(bool)])
        wanted = np.sort(np.concatenate(wanted))
        where = exchange.shard_of(h, shards)
        near = np.flatnonzero(X.lookup(wanted, h) >= 0)
        if not len(near):
            return pa.table({"shard": pa.array([], pa.int32()), "blob": pa.array([], pa.binary()), "marks": pa.array([], pa.binary())})
        row, first, last, h, where = row[near], first[near], last[near], h[near], where[near]
        doc, tie, start = doc_all[row], tie_all[row], first - offs[row]
        size = last - first + length
        key = X.span_hash(buf, first, first + size)
        order = np.lexsort((start, tie, doc, key))
        # a copy is one by its bytes, not by its hash: of its bytes and those of the one before it
        same = np.zeros(len(order), dtype=bool)
        c = 1 + np.flatnonzero((key[order][1:] == key[order][:-1]) & (size[order][1:] == size[order][:-1]))
        same[c] = equal_strings(buf, first[order[c]], first[order[c - 1]], size[order[c]])
        c = np.flatnonzero(same)
        copy, prior = order[c], order[c - 1]
        again = copy[~((doc[copy] == doc[prior]) & (tie[copy] == tie[prior]) & (start[copy] == start[prior]))]
        again = merged_runs(np.stack([doc[again], tie[again], start[again], start[again] + last[again] - first[again]]))
        keep = np.sort(order[~same])
        keep = keep[np.argsort(where[keep], kind="stable")]
        at = np.searchsorted(where[keep], np.arange(shards + 1))
        out_s, out_b, out_m = [], [], []
        for s in range(shards):
            k = keep[at[s] : at[s + 1]]
            if len(k):
                data = pa.compress(buf[X.ranges(first[k], size[k])].tobytes(), "zstd", asbytes=True)
                head = squeeze(np.concatenate([h[k].view(np.int64), doc[k], tie[k], start[k], last[k] - first[k]]))
                out_s.append(s)
                out_b.append(np.int64(len(head)).tobytes() + head + data)
                out_m.append(b"")
        if again.size:
            if not out_s:
                out_s, out_b, out_m = [0], [b""], [b""]
            out_m[0] = squeeze(again)
        return pa.table({"shard": pa.array(out_s, pa.int32()), "blob": pa.array(out_b, pa.binary()), "marks": pa.array(out_m, pa.binary())})

    return held.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(X.tidy_group(pick), "shard int, blob binary, marks binary")


class SuffixArray:
    """Suffixes of several strings, sorted to a depth of at least ``depth`` bytes."""

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        n = len(text)
        #: bytes from each position to its string's end
        self.left = np.repeat(start + size, size) - np.arange(n)
        # seven symbols of nine bits; 0 stands for what is past the end
        key = np.zeros(n, U64)
        wide = text.astype(U64) + U64(1)
        for j in range(7):
            part = np.zeros(n, U64)
            part[: n - j] = wide[j:]
            part[self.left <= j] = 0
            key = (key << U64(9)) | part
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        self._rank(order, key[order][1:] != key[order][:-1], rank)
        h = 7
        while h < depth:
            # groups of one member are final; the others are sorted by the rank h further on
            sorted_rank = rank[order]
            alone = np.ones(n, dtype=bool)
            equal = sorted_rank[1:] == sorted_rank[:-1]
            alone[1:] &= ~equal
            alone[:-1] &= ~equal
            at = np.flatnonzero(~alone)
            if not len(at):
                break
            p = order[at]
            ahead = np.where(self.left[p] > h, rank[np.minimum(p + h, n - 1)] + 1, 0)
            o = np.lexsort((ahead, rank[p]))
            order[at] = p[o]
            a, r = ahead[o], rank[p][o]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
            # ranks are the positions of groups' first members
            lead = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            rank[order[at]] = lead
            h *= 2
        self.order, self.rank = order, rank

    @staticmethod
    def _rank(order: np.ndarray, differ: np.ndarray, rank: np.ndarray) -> None:
        new = np.ones(len(order), dtype=bool)
        new[1:] = differ
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]

    def common_prefixes(self, at: np.ndarray) -> np.ndarray:
        """Kasai: of each suffix in ``at`` (ascending positions) with the one before it in order, up to the depth.

        A suffix shares at least one byte less with the one before it than its
        left neighbour did.  So that arrays can be worked on, the recurrence runs
        over strides: every 64th position is compared from its first byte on,
        and then, with half the stride each time, the positions between start
        with what the position one stride to the left leaves them.
        """
        n = len(self.order)
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        before = np.full(n, -1)
        before[self.order[1:]] = self.order[:-1]
        text, left, depth, rank = self.text, self.left, self.depth, self.rank
        shared = np.zeros(n, np.int64)
        wanted = np.zeros(n, dtype=bool)
        wanted[at[before[at] >= 0]] = True
        done = np.zeros(n, dtype=bool)
        stride = 64
        while stride:
            p = np.arange(0, n, stride)
            p = p[wanted[p] & ~done[p]]
            q = before[p]
            room = np.minimum(np.minimum(left[p], left[q]), depth)
            back = p - stride
            ok = np.flatnonzero(back >= 0)
            ok = ok[done[back[ok]] & (left[back[ok]] == left[p[ok]] + stride)]
            # the neighbour's predecessor, moved along, lies before this suffix unless those two tie to the depth
            ok = ok[(shared[back[ok]] > stride) & (rank[before[back[ok]]] != rank[back[ok]])]
            have = np.zeros(len(p), np.int64)
            have[ok] = np.minimum(shared[back[ok]] - stride, room[ok])
            equal = rank[p] == rank[q]  # to the depth
            have[equal] = room[equal]
            live = np.flatnonzero(have < room)
            while len(live):
                live = live[text[p[live] + have[live]] == text[q[live] + have[live]]]
                have[live] += 1
                live = live[have[live] < room[live]]
            shared[p] = have
            done[p] = True
            stride //= 2
        return shared[at]

    def find(self, windows: np.ndarray, length: int) -> np.ndarray:
        """Binary search: the lowest place in the order of a suffix that begins with each window (rows of bytes), or -1.

        Eight bytes are compared at a time, big end first, the last eight overlapping those before.
        """
        n = len(self.text)
        word = np.zeros(n, U64)
        for j in range(8):
            word[: n - j] |= self.text[j:].astype(U64) << U64(56 - 8 * j)
        full = np.flatnonzero(self.left[self.order] >= length)
        begin = self.order[full]
        offsets = [*range(0, length - 7, 8)]
        offsets += [length - 8] if offsets[-1] + 8 < length else []
        wanted = [np.ascontiguousarray(windows[:, o : o + 8]).view(">u8").ravel().astype(U64) for o in offsets]
        first = word[begin]
        low, high = np.searchsorted(first, wanted[0]), np.searchsorted(first, wanted[0], side="right")
        end = high.copy()

        def compare(place, rows):
            """-1, 0 or 1: how the suffixes at places of ``begin`` lie to the windows, whose first words they share."""
            out, left = np.zeros(len(rows), np.int8), np.arange(len(rows))
            for o, w in zip(offsets[1:], wanted[1:]):
                x, y = word[begin[place[left]] + o], w[rows[left]]
                out[left] = (x > y).astype(np.int8) - (x < y)
                left = left[x == y]
                if not len(left):
                    break
            return out

        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            middle = (low[live] + high[live]) // 2
            less = compare(middle, live) < 0
            low[live[less]], high[live[~less]] = middle[less] + 1, middle[~less]
        out = np.full(len(windows), -1, np.int64)
        ok = np.flatnonzero(low < end)
        ok = ok[compare(low[ok], ok) == 0]
        out[ok] = full[low[ok]]
        return out


def repeats(text: np.ndarray, size: np.ndarray, windows: np.ndarray, anchor: np.ndarray, ref: np.ndarray, length: int, block: int = BLOCK) -> np.ndarray:
    """Flags of the windows of all strings that also start earlier, windows of a string in order.

    anchor: sorted group of each string; ref: three rows (document, tie, first
    window's start) that order windows.  Blocks of at least a string each have
    suffix arrays of their own; those that share an anchor are merged.
    """
    begin = np.cumsum(size) - size
    base = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), dtype=bool)
    cuts, i = [0], 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + block)))
        cuts.append(min(j, len(size)))
        i = cuts[-1]
    earlier: list[tuple] = []  # suffix array, earliest member and lowest place of each run, anchor, members' names
    for a, b in zip(cuts, cuts[1:]):
        own = text[begin[a] : begin[b - 1] + size[b - 1]]
        sa = SuffixArray(own, begin[a:b] - begin[a], size[a:b], length)
        at = X.ranges(begin[a:b] - begin[a], windows[a:b])  # positions of windows, ascending
        string = np.repeat(np.arange(a, b), windows[a:b])
        number = at - (begin[string] - begin[a])
        doc, tie, start = ref[0][string], ref[1][string], ref[2][string] + number
        # runs of equal windows: neighbours in the order that share ``length`` bytes
        place = np.empty(len(own), np.int64)
        place[sa.order] = np.arange(len(own))
        o = np.argsort(place[at], kind="stable")
        prefix = np.zeros(len(own), np.int64)
        prefix[at] = sa.common_prefixes(at)
        # a window is in its predecessor's run if all suffixes between share enough; those that do are windows themselves
        new = np.ones(len(o), dtype=bool)
        new[1:] = (prefix[at[o]][1:] < length) | (np.diff(place[at[o]]) != 1)
        run = np.empty(len(o), np.int64)
        run[o] = np.cumsum(new) - 1
        order = np.lexsort((start, tie, doc, run))
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = run[order][1:] != run[order][:-1]
        rep = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        later = (doc[order] != doc[rep]) | (tie[order] != tie[rep]) | (start[order] != start[rep])
        out[base[string[order[later]]] + number[order[later]]] = True
        # blocks before this one with the same anchors: the first of each run is looked up there
        tail = [e for e in earlier if anchor[a] == e[3]]
        if tail:
            first = order[lead]
            first = first[anchor[string[first]] == anchor[a]]
            rows = own[at[first][:, None] + np.arange(length)]
            for prior, prior_first, prior_place, _, names in tail:
                hit = prior.find(rows, length)
                ok = np.flatnonzero(hit >= 0)
                # the prior block's run of this window and its earliest member
                q = prior_first[np.searchsorted(prior_place, hit[ok], side="right") - 1]
                mine = np.stack([doc[first[ok]], tie[first[ok]], start[first[ok]]])
                theirs = names[:, q]
                less = (theirs[0] < mine[0]) | ((theirs[0] == mine[0]) & ((theirs[1] < mine[1]) | ((theirs[1] == mine[1]) & (theirs[2] < mine[2]))))
                f = first[ok]
                hit_now = f[less]
                out[base[string[hit_now]] + number[hit_now]] = True
                # and the other way round: this block's earliest comes before the prior one's
                more = ~less & ((theirs[0] != mine[0]) | (theirs[1] != mine[1]) | (theirs[2] != mine[2]))
                if more.any():
                    out[names[3, q[more]]] = True
        if b < len(size) and anchor[b] == anchor[b - 1]:
            f = order[lead]
            # a run's lowest place leads to its earliest member
            lowest = o[np.flatnonzero(new)]
            names = np.stack([doc, tie, start, base[string] + number])
            by_run = np.empty(len(f), np.int64)
            by_run[run[f]] = f
            entry = (sa, by_run, place[at[lowest]], anchor[b - 1], names)
            earlier = [e for e in earlier if e[3] == anchor[b - 1]] + [entry]
        else:
            earlier = []
    return out


def _unpack(blob) -> tuple[np.ndarray, np.ndarray]:
    view = memoryview(blob)
    n = int(np.frombuffer(view[:8], np.int64)[0])
    return swell(view[8 : 8 + n], np.int64).reshape(5, -1), view[8 + n :]


def _decide(head: np.ndarray, text: np.ndarray, length: int, block: int) -> list[np.ndarray]:
    """(document, tie, first, last) of repeated windows among snippets that hold all of their anchors' strings."""
    h, doc, tie, start, more = head
    size = more + length
    begin = np.cumsum(size) - size
    key = X.span_hash(text, begin, begin + size)
    order = np.lexsort((start, tie, doc, key, size, h))
    x = np.stack([h[order], size[order], key[order].view(np.int64)])
    same = np.zeros(len(order), dtype=bool)
    copy = 1 + np.flatnonzero((x[:, 1:] == x[:, :-1]).all(axis=0))
    same[copy] = equal_strings(text, begin[order[copy]], begin[order[copy - 1]], size[order[copy]])
    copy = np.flatnonzero(same)
    again, prior = order[copy], order[copy - 1]
    again = again[~((doc[again] == doc[prior]) & (tie[again] == tie[prior]) & (start[again] == start[prior]))]
    done = [np.stack([doc[again], tie[again], start[again], start[again] + more[again]])]
    left = order[~same]  # by anchor, its different snippets together
    several = np.zeros(len(left), dtype=bool)
    eq = h[left][1:] == h[left][:-1]
    several[1:] |= eq
    several[:-1] |= eq
    left = left[several]
    if len(left):
        flags = repeats(text[X.ranges(begin[left], size[left])], size[left], more[left] + 1, h[left], (doc[left], tie[left], start[left]), length, block)
        # maximal runs of marked windows in each snippet
        string = np.repeat(np.arange(len(left)), more[left] + 1)
        number = X.ranges(np.zeros(len(left), np.int64), more[left] + 1)
        p = np.flatnonzero(flags)
        if len(p):
            new = np.ones(len(p), dtype=bool)
            new[1:] = (np.diff(p) != 1) | (string[p][1:] != string[p][:-1])
            a = p[new]
            z = p[np.append(np.flatnonzero(new)[1:], len(p)) - 1]
            s = left[string[a]]
            done.append(np.stack([doc[s], tie[s], start[s] + number[a], start[s] + number[z]]))
    return done


def marks(found: DataFrame, length: int, block: int) -> DataFrame:
    """(home, blob): windows of documents that are repeats, by the shard of their document."""
    homes = runtime.shuffle_partitions(found.sparkSession)

    def decide(group: pa.Table) -> pa.Table:
        done = [swell(m.as_buffer(), np.int64).reshape(4, -1) for m in group.column("marks") if len(m.as_buffer())]
        heads, data = [], []
        for x in group.column("blob"):
            if len(x.as_buffer()):
                head, packed = _unpack(x.as_buffer())
                heads.append(head)
                data.append(np.frombuffer(pa.decompress(pa.py_buffer(packed), int((head[4] + length).sum()), "zstd", asbytes=True), np.uint8))
        if heads:
            head, text = np.concatenate(heads, axis=1), np.concatenate(data)
            size = head[4] + length
            begin = np.cumsum(size) - size
            by_anchor = np.argsort(head[0], kind="stable")
            total = np.cumsum(size[by_anchor])
            i = 0
            while i < len(by_anchor):  # whole anchors, a bounded number of bytes at a time
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + block)))
                j = int(np.searchsorted(head[0][by_anchor], head[0][by_anchor[min(j, len(by_anchor)) - 1]], side="right"))
                own = by_anchor[i:j]
                done += _decide(head[:, own], text[X.ranges(begin[own], size[own])], length, block)
                i = j
        if not done:
            return pa.table({"home": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        m = np.concatenate(done, axis=1)
        home = exchange.shard_of(X.mix(X.mix(m[0].view(U64)) + m[1].view(U64)), homes)
        order = np.lexsort((m[2], m[1], m[0], home))
        m, home = m[:, order], home[order]
        at = np.searchsorted(home, np.arange(homes + 1))
        some = np.flatnonzero(at[1:] > at[:-1])
        return pa.table({"home": pa.array(some, pa.int32()), "blob": pa.array([squeeze(m[:, at[s] : at[s + 1]]) for s in some], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        m = np.concatenate([swell(x.as_buffer(), np.int64).reshape(4, -1) for x in group.column("blob")], axis=1)
        m = m[:, np.lexsort((m[2], m[1], m[0]))]
        new = np.ones(m.shape[1], dtype=bool)
        new[1:] = (m[0][1:] != m[0][:-1]) | (m[1][1:] != m[1][:-1])
        at = np.append(np.flatnonzero(new), m.shape[1])
        spans = []
        for a, z in zip(at, at[1:]):
            lo, hi = m[2, a:z], np.maximum.accumulate(m[3, a:z] + length)
            cut = np.ones(len(lo), dtype=bool)
            cut[1:] = lo[1:] > hi[:-1]
            s = np.flatnonzero(cut)
            spans.append(np.stack([lo[s], hi[np.append(s[1:], len(lo)) - 1]]).astype(np.int64).tobytes())
        return pa.table({"doc": pa.array(m[0][at[:-1]]), "tie": pa.array(m[1][at[:-1]]), "spans": pa.array(spans, pa.binary())})

    found = found.groupBy("shard").applyInArrow(X.tidy_group(decide), "home int, blob binary")
    return found.groupBy("home").applyInArrow(X.tidy_group(gather), "doc bigint, tie bigint, spans binary")


_SMALLEST = -(1 << 63)


def find_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc, tie, text, spans) of every row; spans: maximal removed byte ranges, two packed rows of longs, or null."""
    spark = docs.sparkSession
    shards = 4 * runtime.shuffle_partitions(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_SMALLEST)).alias("doc"), F.xxhash64(body).alias("tie"), body.alias("text"))
    held, _ = runtime.written(bundled(rows), "bundles")
    found = snippets(held, repeated_anchors(held, length, shards), length, shards)
    spans = marks(found, length, block)

    def places(batches):
        for b in batches:
            for bundle, head in zip(b.column(0).to_pylist(), b.column(1)):
                doc, tie, _ = swell(head.as_buffer(), np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(np.full(len(doc), bundle))], names=["doc", "tie", "bundle"])

    def unpack(own: pa.Table, marked: pa.Table) -> pa.Table:
        doc, tie, buf, offs = unbundled(own.column("head")[0], own.column("data")[0])
        known = {(d, t): s for d, t, s in zip(marked.column("doc").to_pylist(), marked.column("tie").to_pylist(), marked.column("spans").to_pylist())}
        texts = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(buf)])
        return pa.table({"doc": pa.array(doc), "tie": pa.array(tie), "text": texts.cast(pa.string()), "spans": pa.array([known.get(x) for x in zip(doc.tolist(), tie.tolist())], pa.binary())})

    where = held.select("bundle", "head").mapInArrow(X.tidy(places), "doc bigint, tie bigint, bundle bigint").distinct()
    placed = spans.join(where, ["doc", "tie"])
    return held.groupBy("bundle").cogroup(placed.groupBy("bundle")).applyInArrow(X.tidy_group(unpack), "doc bigint, tie bigint, text string, spans binary")


def report(docs: DataFrame, *, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = find_repeats(docs, length=length, block=block)

    def run(batches):
        for b in batches:
            buf, offs = X.column(b, 1)
            removed, n_spans, digest = [], [], []
            for r, s in enumerate(b.column(2)):
                own = buf[offs[r] : offs[r + 1]]
                if s.is_valid:
                    lo, hi = np.frombuffer(s.as_buffer(), np.int64).reshape(2, -1)
                    step = np.zeros(len(own) + 1, np.int64)
                    step[lo] += 1
                    step[hi] -= 1
                    own = own[np.cumsum(step)[:-1] == 0]
                    removed.append(int((hi - lo).sum()))
                    n_spans.append(len(lo))
                else:
                    removed.append(0)
                    n_spans.append(0)
                digest.append(hashlib.sha256(own.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    doc = F.when(F.col("doc") != _SMALLEST, F.col("doc")).alias("doc_id")
    return found.select(doc, "text", "spans").mapInArrow(X.tidy(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

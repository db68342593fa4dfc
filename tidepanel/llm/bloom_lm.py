"""Language-model scores from a log-frequency Bloom filter.

Texts are cut once into bundles of a few megabytes: per bundle the distinct
tokens (64-bit hashes), how often training documents hold each, and every
document as numbers into that list.  Token counts are summed over sharded key
ranges and answered to each bundle, so no table of all tokens is sent to one
place.  Tokens seen at least twice in training get dense ids; pairs of them are
counted in the same sharded way, and pairs seen at least ``least`` times go into
a Bloom filter: a pair with quantised log count j is inserted at levels 1 to j,
and is read back by probing level after level until one fails.  Counts are
decoded to the lower end of their level, so that the probabilities of a context
do not sum to more than one but for false positives.

    P(w | u) = max(q(uw) - D, 0) / c(u) + (1 - sum_x (q(ux) - D) / c(u)) P(w)

P(w) is the add-0.1 unigram with exact counts; the weight left to it is kept as
one float a context.  Filter and weights are broadcast, at most ``FILTER_MB`` of
the one and ``CONTEXTS`` of the other at a time: beyond that the bundles are
scored in several passes, one a range of filter shards and of contexts, each
token in the pass that holds its pair and context, and the passes' sums are added
up.  The model is the same at any number of passes.

Tokens: runs of everything but ASCII white space, A-Z lower-cased, and an end
token a text.  Null texts are empty: one end token.  A null doc_id hashes as
the empty string.  Rows that repeat are scored (and counted) each.  Texts are
taken whole, a long one is a bundle of its own; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, runtime
from . import textops as X
from .exchange import deltas, squeeze, swell

U64 = np.uint64
END = U64(0x0123456789ABCDEF)
PSEUDO = 0.1
DISCOUNT = 0.5
BASE = 1.5
PROBES = 8
BITS_PER_KEY = 12
LEAST = 2
FILTER_MB = 64
CONTEXTS = 16_000_000
BUNDLE_BYTES = 4 << 20
FLUSH = 1 << 20


def held_out(doc_id: str, modulus: int = 10):
    """True where crc32 of the id as text leaves no remainder."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == 0


def bundles(docs: DataFrame, doc_id: str, text: str, held) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            buf, offs = X.column(b, 2)
            out_all = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in X.slices(offs, BUNDLE_BYTES):
                w = X.Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = np.diff(w.first) + 1
                ends = np.cumsum(n) - 1
                h = np.empty(int(n.sum()), U64)
                word = np.ones(len(h), dtype=bool)
                word[ends] = False
                h[word], h[ends] = w.hash, END
                unique, back = np.unique(h, return_inverse=True)
                train = np.repeat(~out_all[i:j], n)
                seen = np.bincount(back[train], minlength=len(unique))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(task << 32) | number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i)),
                        pa.array([squeeze(out_all[i:j].astype(np.uint8))], pa.binary()),
                        pa.array([squeeze(n)], pa.binary()),
                        pa.array([squeeze(back.astype(np.uint32))], pa.binary()),
                        pa.array([squeeze(deltas(unique))], pa.binary()),
                        pa.array([squeeze(seen.astype(np.int64))], pa.binary()),
                    ],
                    names=["bundle", "doc_ids", "held", "sizes", "seq", "tokens", "seen"],
                )
                number += 1

    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(X.tidy(run), f"bundle bigint, doc_ids array<{kind}>, held binary, sizes binary, seq binary, tokens binary, seen binary")


def token_counts(held: DataFrame, shards: int) -> DataFrame:
    """Answers (bundle, shard, counts) in the order of the bundle's tokens; bundle -1 has a shard's totals."""

    def ask(batches):
        for b in batches:
            for bundle, tokens, seen in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                h, c = np.cumsum(swell(tokens.as_buffer(), U64), dtype=U64), swell(seen.as_buffer(), np.int64)
                at = exchange.cuts(h, shards)
                some = np.flatnonzero(at[1:] > at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(np.full(len(some), bundle)), pa.array([squeeze(deltas(h[at[s] : at[s + 1]])) for s in some], pa.binary()), pa.array([squeeze(c[at[s] : at[s + 1]]) for s in some], pa.binary())],
                    names=["shard", "bundle", "tokens", "seen"],
                )

    def answer(group: pa.Table) -> pa.Table:
        tokens = [np.cumsum(swell(x.as_buffer(), U64), dtype=U64) for x in group.column("tokens")]
        unique, back = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([swell(x.as_buffer(), np.int64) for x in group.column("seen")]).astype(float), minlength=len(unique)).astype(np.int64)
        shard = group.column("shard")[0].as_py()
        cut = np.cumsum([0] + [len(t) for t in tokens])
        # totals: tokens and distinct tokens in training, and how many have each count; ids go by falling count
        known = total[total > 0]
        levels = np.bincount(np.minimum(known, 63), minlength=64)
        rank = np.full(len(unique), -1, np.int64)
        often = total >= LEAST
        rank[np.flatnonzero(often)[np.argsort(-total[often], kind="stable")]] = np.arange(int(often.sum()))
        rows = [(bundle, squeeze(total[back[cut[i] : cut[i + 1]]]), squeeze(rank[back[cut[i] : cut[i + 1]]])) for i, bundle in enumerate(group.column("bundle").to_pylist())]
        rows.append((-1, squeeze(np.concatenate([[int(known.sum()), len(known)], levels]).astype(np.int64)), b""))
        bundle, counts, ranks = zip(*rows)
        return pa.table({"bundle": pa.array(bundle, pa.int64()), "shard": pa.array([shard] * len(rows), pa.int32()), "counts": pa.array(counts, pa.binary()), "ranks": pa.array(ranks, pa.binary())})

    asked = held.select("bundle", "tokens", "seen").mapInArrow(X.tidy(ask), "shard int, bundle bigint, tokens binary, seen binary")
    return asked.groupBy("shard").applyInArrow(X.tidy_group(answer), "bundle bigint, shard int, counts binary, ranks binary")


def resolved(held: DataFrame, answers: DataFrame, given: np.ndarray) -> DataFrame:
    """Bundles with counts and ids of their tokens in the place of the tokens.

    given: how many ids each shard has; its most frequent tokens get them.
    """
    shared = held.sparkSession.sparkContext.broadcast((given, np.cumsum(given) - given))

    def meet(own: pa.Table, answered: pa.Table) -> pa.Table:
        if not own.num_rows:
            return own.drop_columns(["tokens", "seen"]).append_column("counts", pa.array([], pa.binary())).append_column("ids", pa.array([], pa.binary()))
        shard = answered.column("shard").to_numpy()
        order = np.argsort(shard)
        counts, ranks = answered.column("counts"), answered.column("ranks")
        c = np.concatenate([swell(counts[int(i)].as_buffer(), np.int64) for i in order])
        given, base = shared.value
        parts = []
        for i in order:
            r = swell(ranks[int(i)].as_buffer(), np.int64)
            parts.append(np.where((r >= 0) & (r < given[shard[i]]), r + base[shard[i]], -1))
        out = own.drop_columns(["tokens", "seen"])
        return out.append_column("counts", pa.array([squeeze(c)], pa.binary())).append_column("ids", pa.array([squeeze(np.concatenate(parts))], pa.binary()))

    kind = dict(held.dtypes)["doc_ids"]
    return held.groupBy("bundle").cogroup(answers.filter("bundle >= 0").groupBy("bundle")).applyInArrow(
        X.tidy_group(meet), f"bundle bigint, doc_ids {kind}, held binary, sizes binary, seq binary, counts binary, ids binary"
    )


def _pairs(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    """Pair keys of each token with the one before it (the end token before a text's first); -1: not both have ids."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = end_id
    return np.where((before >= 0) & (ids >= 0), (before << 32) | ids, -1)


def _shard_key(pairs: np.ndarray) -> np.ndarray:
    return X.mix(pairs.astype(U64))


def pair_counts(bundle_rows: DataFrame, shards: int, end_id: int) -> DataFrame:
    """(shard, pairs, counts) of pairs that training has at least LEAST times."""

    def pack(pieces):
        pairs, n = np.unique(np.concatenate(pieces), return_counts=True)
        where = exchange.shard_of(_shard_key(pairs), shards)
        order = np.argsort(where, kind="stable")
        pairs, n, at = pairs[order], n[order], np.searchsorted(where[order], np.arange(shards + 1))
        some = np.flatnonzero(at[1:] > at[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([squeeze(deltas(pairs[at[s] : at[s + 1]])) for s in some], pa.binary()), pa.array([squeeze(n[at[s] : at[s + 1]].astype(np.int64)) for s in some], pa.binary())],
            names=["shard", "pairs", "counts"],
        )

    def count(batches):
        pieces, size = [], 0
        for b in batches:
            for held, sizes, seq, ids in zip(*(b.column(c) for c in range(4))):
                n = swell(sizes.as_buffer(), np.int64)
                token = swell(ids.as_buffer(), np.int64)[swell(seq.as_buffer(), np.uint32)]
                pairs = _pairs(token, n, end_id)
                train = np.repeat(swell(held.as_buffer(), np.uint8) == 0, n)
                pairs = pairs[train & (pairs >= 0)]
                pieces.append(pairs)
                size += len(pairs)
                if size >= 4 * FLUSH:
                    yield pack(pieces)
                    pieces, size = [], 0
        if size:
            yield pack(pieces)

    def total(group: pa.Table) -> pa.Table:
        pairs = np.concatenate([np.cumsum(swell(x.as_buffer(), np.int64)) for x in group.column("pairs")])
        n = np.concatenate([swell(x.as_buffer(), np.int64) for x in group.column("counts")])
        unique, back = np.unique(pairs, return_inverse=True)
        n = np.bincount(back, weights=n.astype(float), minlength=len(unique)).astype(np.int64)
        keep = n >= LEAST
        unique, n = unique[keep], n[keep]
        return pa.table({"shard": group.column("shard")[:1], "pairs": pa.array([squeeze(deltas(unique))], pa.binary()), "counts": pa.array([squeeze(n)], pa.binary()), "levels": pa.array([np.bincount(level(n), minlength=64).tolist()], pa.list_(pa.int64()))})

    rows = bundle_rows.select("held", "sizes", "seq", "ids").mapInArrow(X.tidy(count), "shard int, pairs binary, counts binary")
    return rows.groupBy("shard").applyInArrow(X.tidy_group(total), "shard int, pairs binary, counts binary, levels array<bigint>")


def level(n: np.ndarray) -> np.ndarray:
    """Quantised log count, 1 for LEAST; 0 below it."""
    return np.where(n >= LEAST, 1 + np.floor(np.log(np.maximum(n, LEAST) / LEAST) / np.log(BASE) + 1e-12), 0).astype(np.int64)


def decoded(j: np.ndarray) -> np.ndarray:
    return np.where(j > 0, LEAST * BASE ** (j - 1.0), 0.0)


class LogBloom:
    """Bloom filter segments, one a shard, of (key, level) pairs."""

    def __init__(self, bits: list[np.ndarray], sizes: list[int]):
        self.bits = np.concatenate([*bits, np.zeros(8, np.uint8)])
        self.size = np.array(sizes, np.int64)
        self.start = np.cumsum([0] + [8 * len(b) for b in bits])[:-1]

    @staticmethod
    def probe(keys: np.ndarray, j, i: int) -> np.ndarray:
        return X.mix(keys ^ X.mix(np.asarray(j, dtype=U64) * U64(PROBES) + U64(i)))

    @classmethod
    def segment(cls, keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
        total = int(levels.sum())
        if not total:
            return np.empty(0, np.uint8), 0
        size = max(64, total * BITS_PER_KEY)
        flags = np.zeros(-(-size // 8) * 8, dtype=bool)
        k = np.repeat(keys, levels)
        j = X.ranges(np.ones(len(levels), np.int64), levels)
        for i in range(PROBES):
            flags[(cls.probe(k, j, i) % U64(size)).astype(np.int64)] = True
        return np.packbits(flags), size

    def levels(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Levels that probing reads back."""
        out = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(self.size[shards] > 0)
        j = 1
        while len(live):
            for i in range(PROBES):
                size, start = self.size[shards[live]], self.start[shards[live]]
                at = start + (self.probe(keys[live], j, i) % size.astype(U64)).astype(np.int64)
                live = live[(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
                if not len(live):
                    break
            out[live] = j
            j += 1
        return out


def runs(sizes: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to at most ``most`` (a larger one is alone), covering all."""
    out, first, sum_ = [], 0, 0.0
    for i, size in enumerate(sizes.tolist()):
        if i > first and sum_ + size > most:
            out.append((first, i))
            first, sum_ = i, 0.0
        sum_ += size
    return [*out, (first, len(sizes))]


def segments(pairs: DataFrame, ends: np.ndarray) -> DataFrame:
    """(shard, bits, size, run): the filter's segments, in a folder a run of shards; ends: where each run ends."""

    def build(batches):
        for b in batches:
            for shard, keys, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                k, j = np.cumsum(swell(keys.as_buffer(), np.int64)), level(swell(n.as_buffer(), np.int64))
                bits, size = LogBloom.segment(_shard_key(k), j)
                run = int(np.searchsorted(ends, shard, side="right"))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([bits.tobytes()], pa.binary()), pa.array([size], pa.int64()), pa.array([run], pa.int32())], names=["shard", "bits", "size", "run"])

    made = pairs.select("shard", "pairs", "counts").mapInArrow(X.tidy(build), "shard int, bits binary, size bigint, run int")
    return runtime.written(made, "filter", ["run"])[0]


def load_filter(made: DataFrame, first: int, end: int) -> LogBloom:
    """The filter of the shards from first to before end, whose segments ``made`` holds."""
    bits, sizes = [np.empty(0, np.uint8)] * (end - first), [0] * (end - first)
    own = made.select("shard", "bits", "size").toArrow()
    for shard, b, size in zip(own.column(0).to_pylist(), own.column(1), own.column(2).to_pylist()):
        bits[shard - first], sizes[shard - first] = np.frombuffer(b.as_buffer(), np.uint8), size
    return LogBloom(bits, sizes)


def context_mass(pairs: DataFrame, shards: int, n_ids: int) -> DataFrame:
    """(shard, ids, mass): per id the sum of (decoded count - D) over its pairs, as float32, in shards that are ranges of ids."""

    def pack(parts):
        ids, mass = (np.concatenate(x) for x in zip(*parts))
        u, back = np.unique(ids, return_inverse=True)
        mass = np.bincount(back, weights=mass, minlength=len(u))
        where = u * shards // max(1, n_ids)
        at = np.searchsorted(where, np.arange(shards + 1))
        some = np.flatnonzero(at[1:] > at[:-1])
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([squeeze(u[at[s] : at[s + 1]]) for s in some], pa.binary()), pa.array([squeeze(mass[at[s] : at[s + 1]]) for s in some], pa.binary())], names=["shard", "ids", "mass"])

    def part(batches):
        # a task's shards are added up before they are dealt out by context
        parts, size = [], 0
        for b in batches:
            for keys, n in zip(b.column(1), b.column(2)):
                k, j = np.cumsum(swell(keys.as_buffer(), np.int64)), level(swell(n.as_buffer(), np.int64))
                u, back = np.unique(k >> 32, return_inverse=True)
                parts.append((u, np.bincount(back, weights=decoded(j) - DISCOUNT, minlength=len(u))))
                size += len(u)
                if size >= 4 * FLUSH:
                    yield pack(parts)
                    parts, size = [], 0
        if size:
            yield pack(parts)

    def total(group: pa.Table) -> pa.Table:
        u = np.concatenate([swell(x.as_buffer(), np.int64) for x in group.column("ids")])
        m = np.concatenate([swell(x.as_buffer(), np.float64) for x in group.column("mass")])
        ids, back = np.unique(u, return_inverse=True)
        return pa.table({"shard": group.column("shard")[:1], "ids": pa.array([squeeze(ids.astype(np.uint32))], pa.binary()), "mass": pa.array([squeeze(np.bincount(back, weights=m).astype(np.float32))], pa.binary())})

    made = pairs.select("shard", "pairs", "counts").mapInArrow(X.tidy(part), "shard int, ids binary, mass binary").groupBy("shard").applyInArrow(X.tidy_group(total), "shard int, ids binary, mass binary")
    return runtime.written(made, "mass")[0]


def load_mass(made: DataFrame, first: int, end: int, ids: tuple[int, int]) -> np.ndarray:
    """Mass of each id of a range, which shards first to end hold."""
    out = np.zeros(ids[1] - ids[0], np.float32)
    rows = made.filter(F.col("shard").between(first, end - 1)).select("ids", "mass").toArrow()
    for u, mass in zip(rows.column(0), rows.column(1)):
        out[swell(u.as_buffer(), np.uint32).astype(np.int64) - ids[0]] = swell(mass.as_buffer(), np.float32)
    return out


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    shards = 4 * runtime.shuffle_partitions(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    raw, raw_path = runtime.written(bundles(docs, doc_id, text, held_out(doc_id, modulus)), "bundles")
    answers, answers_path = runtime.written(token_counts(raw, shards), "answers")
    stats = np.zeros((shards, 66), np.int64)
    for r in answers.filter("bundle < 0").select("shard", "counts").collect():  # one row a shard
        stats[r["shard"]] = swell(r["counts"], np.int64)
    n_train, n_distinct = int(stats[:, 0].sum()), int(stats[:, 1].sum())
    given = stats[:, 2 + LEAST :].sum(axis=1)
    n_ids = int(given.sum())
    rows, _ = runtime.written(resolved(raw, answers, given), "resolved")
    runtime.delete_path(spark, raw_path)
    runtime.delete_path(spark, answers_path)
    # the end token's id is found where its hash lies; it is the context of every first token
    end_id = -1
    end_count = 0
    first = rows.select("sizes", "seq", "ids", "counts").limit(1).collect()
    if first:
        at = swell(first[0]["seq"], np.uint32)[swell(first[0]["sizes"], np.int64)[0] - 1]
        end_id, end_count = int(swell(first[0]["ids"], np.int64)[at]), int(swell(first[0]["counts"], np.int64)[at])
    pairs, _ = runtime.written(pair_counts(rows, shards, end_id), "pairs")
    size = np.zeros(shards)
    for r in pairs.select("shard", "levels").collect():  # one row a shard
        size[r["shard"]] = np.dot(r["levels"], np.arange(64)) * BITS_PER_KEY / 8e6
    filter_runs = runs(size, FILTER_MB)
    filters = segments(pairs, np.array([z for _, z in filter_runs]))
    mass_shards = max(runtime.shuffle_partitions(spark), -(-2 * n_ids // CONTEXTS))
    masses = context_mass(pairs, mass_shards, n_ids)
    bounds = -(-np.arange(mass_shards + 1) * max(1, n_ids) // mass_shards)
    mass_runs = runs(np.diff(bounds), CONTEXTS)
    passes = [(f, m) for m in range(len(mass_runs)) for f in range(len(filter_runs))]

    def scored(f: int, m: int):
        """Broadcast and rows of one pass: a bundle's sums, and what does not depend on the filter with the first pass."""
        here, ids_here = filter_runs[f], tuple(int(bounds[x]) for x in mass_runs[m])
        shared = spark.sparkContext.broadcast((load_filter(filters.filter(F.col("run") == f), 0, shards), load_mass(masses, *mass_runs[m], ids_here)))

        def run(batches):
            filter_, mass = shared.value
            unknown = n_train + PSEUDO * (n_distinct + 1)
            for b in batches:
                for bundle, doc_ids, held, sizes, seq, counts, ids in zip(b.column(0).to_pylist(), *(b.column(c) for c in range(1, 7))):
                    n = swell(sizes.as_buffer(), np.int64)
                    seq = swell(seq.as_buffer(), np.uint32)
                    counts = swell(counts.as_buffer(), np.int64)
                    c, token = counts[seq], swell(ids.as_buffer(), np.int64)[seq]
                    start = np.cumsum(n) - n
                    before_c = np.empty(len(c), np.int64)
                    before_c[1:] = c[:-1]
                    before_id = np.empty(len(c), np.int64)
                    before_id[1:] = token[:-1]
                    before_c[start], before_id[start] = end_count, end_id
                    key = _pairs(token, n, end_id)
                    # what has no pair counts to the first shard, what has no context to the first id
                    mine = np.ones(len(key), dtype=bool)
                    if len(filter_runs) > 1:
                        shard = np.where(key >= 0, exchange.shard_of(_shard_key(key), shards), 0)
                        mine &= (shard >= here[0]) & (shard < here[1])
                    if len(mass_runs) > 1:
                        context = np.maximum(before_id, 0)
                        mine &= (context >= ids_here[0]) & (context < ids_here[1])
                    own = np.flatnonzero(mine)
                    key, known = key[own], before_id[own] >= 0
                    has = np.flatnonzero(key >= 0)
                    k, back = np.unique(key[has], return_inverse=True)
                    h = _shard_key(k)
                    q = np.zeros(len(key))
                    q[has] = decoded(filter_.levels(h, exchange.shard_of(h, shards)))[back]
                    left = np.ones(len(own))
                    left[known] = np.maximum(1 - mass[before_id[own[known]] - ids_here[0]] / before_c[own[known]], 1e-6)
                    smooth = np.where(known, np.maximum(q - DISCOUNT, 0) / np.maximum(before_c[own], 1), 0.0) + left * (c[own] + PSEUDO) / unknown
                    sums = np.bincount(np.repeat(np.arange(len(n)), n)[own], weights=np.log10(np.minimum(smooth, 1.0)), minlength=len(n))
                    head = [None] * 4
                    if (f, m) == passes[0]:
                        numbers = np.concatenate([n, np.add.reduceat((c > 0).astype(np.int64), start)])
                        head = [doc_ids.as_py(), held.as_py(), squeeze(numbers), squeeze(np.add.reduceat(np.log10((c + PSEUDO) / unknown), start))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bundle], pa.int64()), pa.array([head[0]], b.column(1).type), *(pa.array([x], pa.binary()) for x in head[1:]), pa.array([squeeze(sums)], pa.binary())],
                        names=["bundle", "doc_ids", "held", "numbers", "base", "sums"],
                    )

        def whole(batches):
            # the only pass ends in the worker that scores: a second Python stage would hold its memory again
            for part in run(batches):
                yield from add(pa.Table.from_batches([part])).to_batches()

        own = rows.select("bundle", "doc_ids", "held", "sizes", "seq", "counts", "ids")
        if len(passes) == 1:
            return shared, own.mapInArrow(X.tidy(whole, shared), schema)
        return shared, own.mapInArrow(X.tidy(run, shared), f"bundle bigint, doc_ids array<{kind}>, held binary, numbers binary, base binary, sums binary")

    def add(group: pa.Table) -> pa.Table:
        """Scores of a bundle's documents from its rows of all passes."""
        at = int(np.flatnonzero(group.column("held").is_valid().to_numpy())[0])
        sums = np.sum([swell(x.as_buffer(), np.float64) for x in group.column("sums")], axis=0)
        numbers = swell(group.column("numbers")[at].as_buffer(), np.int64).reshape(2, -1)
        held = swell(group.column("held")[at].as_buffer(), np.uint8).astype(bool)
        return pa.table(
            [group.column("doc_ids")[at].values, pa.array(held), pa.array(numbers[0]), pa.array(numbers[1]), pa.array(np.full(len(held), n_train)), pa.array(swell(group.column("base")[at].as_buffer(), np.float64)), pa.array(sums)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    if len(passes) == 1:
        return scored(*passes[0])[1]
    parts = []
    for x in passes:
        shared, part = scored(*x)
        parts.append(runtime.written(part, "sums")[0])
        shared.destroy()
    return functools.reduce(DataFrame.unionAll, parts).groupBy("bundle").applyInArrow(X.tidy_group(add), schema)

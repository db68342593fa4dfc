"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct k-word shingles (64-bit hashes).  Equal
sets are one class.  Classes that can link meet exactly, without any loss, by
the pigeonhole rule: sets of sizes a and b whose Jaccard similarity is at least
s differ in at most (a+b)(1-s)/(1+s) shingles, so of more hashed shingle groups
than that all but so many are the same in both.  Only group signatures travel;
classes that have too few of them in common with any others fall out, the rest
leave out what the count allows (a prefix filter), and a signature that many
classes share leaves one star of candidate edges, never all pairs.  Connected candidates are then joined: shingles hashed
to ``DIMENSIONS`` groups give a point of group counts, the points go into a bulk
loaded R-tree, a node or point whose summed coordinate minima with the query
fall short of the needed overlap is passed over; what this bound does not
connect is parted before any sets travel, and surviving pairs are verified on
the sets.  Large candidate groups are dealt into chunks; chunks are
joined alone, then their components through representatives, then whatever is
still apart, exactly.

Words are runs of everything but ASCII white space, A-Z lower-cased.  A text of
fewer than k words has its whole sequence as one shingle; a null text or one
without words has none and links with nothing, itself being its component.
Rows that repeat are members of the same component.  A null doc_id is never the
smallest while another is there.  Texts are taken whole, whatever their length;
an empty table gives no rows.  Other columns are not read, and are passed on by
deduplicate() whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, runtime
from . import textops as X
from .exchange import squeeze, swell

U64 = np.uint64
DIMENSIONS = 64
FANOUT = 16
#: classes of one candidate group that ask in one task what the bound alone connects
PARTED = 4000
#: shingles of one candidate group that are joined in one task, a set counting for ``SET`` more
CHUNK = 1 << 20
SET = 256
#: classes in candidate groups whose labels are broadcast (16 bytes each)
BROADCAST_LABELS = 4_000_000
#: signatures that a task holds before it hands them on
FLUSH = 1 << 18
#: bytes of text that are hashed at once, but one row at least
SLICE_BYTES = 1 << 18
#: classes of one flush with the same signature that go to its shard; of more, one goes
LOCAL = 64
#: shingles that are compared at a time
COMPARED = 1 << 20


def need(a, b, percent: int):
    """Least overlap of sets of sizes a and b: 100 * i >= percent * (a + b - i)."""
    return -(-(percent * (a + b)) // (100 + percent))


class Layout:
    """Size levels and their numbers of groups for a similarity of percent/100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.step = math.log(100 / percent) if percent < 100 else 1.0

    def level(self, n: np.ndarray) -> np.ndarray:
        # nudged down: on an edge the lower level is as right, as neighbours meet anyway
        return np.floor(np.log(np.maximum(n, 1)) / self.step + 1e-9).astype(np.int64)

    def groups(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By level: number of groups, groups that may differ, and the least shingles of a group that is sent."""
        levels, back = np.unique(level, return_inverse=True)
        out = np.array([self._plan(int(v)) for v in levels], np.int64).reshape(-1, 3)[back]
        return out[:, 0], out[:, 1], out[:, 2]

    @functools.lru_cache(4096)  # noqa: B019
    def _plan(self, level: int) -> tuple[int, int, int]:
        # sizes below the upper edge; of more groups than can differ some are the same, and of those
        # not all are small unless both sets have that many small groups
        # (least 1: a third more groups than can differ, so that linked sets share many signatures)
        top = math.floor(math.exp((level + 1) * self.step) * (1 + 1e-9) + 1e-6)
        differ = 2 * top * (100 - self.percent) // (100 + self.percent)
        rare = differ + 2, differ, 1, 2.0
        for least in (6, 5, 4, 3, 2, 1):
            for ratio in (1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4) if least > 1 else (1.3, 1.4, 1.5, 2.0, 3.0):
                groups = max(math.ceil(differ * ratio) + 1, differ + 2)
                mean = math.exp((level - 0.5) * self.step) / groups
                small = groups * sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(least))
                if small + 1.5 * math.sqrt(small) <= groups - differ - 1:
                    return groups, differ, least
                # few shingles: the number of groups that leaves a set's groups empty most seldom
                over = (small - (groups - differ)) / math.sqrt(small + 1e-9)
                if least == 1 and over < rare[3]:
                    rare = groups, differ, 1, over
        return rare[:3]


def set_hash(row: np.ndarray, x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, hash) of each row's set, from sorted distinct (row, shingle)."""
    n = np.bincount(row, minlength=rows).astype(np.int64)
    h = np.zeros(rows, U64)
    full = np.flatnonzero(n)
    if len(full):
        start = (np.cumsum(n) - n)[full]
        h[full] = np.add.reduceat(X.mix(x), start) ^ X.mix(np.add.reduceat(X.mix(x ^ U64(0xA5A5A5A5A5A5A5A5)), start))
    return n, X.mix(h + n.astype(U64))


#: bits of a signature beside its size level: fewer would let chance join sets of a very large corpus
HASH_BITS = 48


def with_level(key: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A signature of ``HASH_BITS`` and its size level in the last byte; levels above it share their last byte."""
    return ((key >> U64(64 - HASH_BITS)) << U64(8)) | (level.astype(U64) & U64(255))


def signatures(row: np.ndarray, x: np.ndarray, n: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document row, key, shared) of the groups of each document at its two levels.

    Small groups, which chance makes equal most often, are left out unless a
    document has so many that all groups it shares could be small ones.
    shared: how many keys of that level the document has in common at least with
    any set that it links with, as of the groups that are the same no more than
    those that it does not send are without a key.
    """
    rows = len(n)
    keys, owners, least_shared = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for up in (0, 1):
        level = layout.level(n) + up
        groups, differ, least = layout.groups(level)
        live = (n > 0) & (differ > 0)  # else only equal sets can link
        g = np.where(live, groups, 0)
        base = np.cumsum(g) - g
        ok = live[row]
        if not ok.any():
            continue
        r, y = row[ok], X.mix(x[ok] + (level[row[ok]].astype(U64) << U64(17)))
        at = base[r] + (((y >> U64(32)) * g[r].astype(U64)) >> U64(32)).astype(np.int64)
        total = int(g.sum())
        z = X.mix(y)
        count = np.bincount(at, minlength=total)
        lo = np.bincount(at, weights=(z & U64(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(U64)
        hi = np.bincount(at, weights=(z >> U64(32)).astype(np.float64), minlength=total).astype(U64)
        owner = np.repeat(np.arange(rows), g)
        number = np.arange(total) - np.repeat(base, g)
        salt = X.mix((level[owner].astype(U64) << U64(32)) + number.astype(U64))
        key = with_level(X.mix(X.mix(lo) + (hi << U64(1)) + salt), level[owner])
        sent = count >= np.maximum(least, 1)[owner]
        few = g - np.bincount(owner[sent], minlength=rows)
        sent |= (count > 0) & (few >= groups - differ)[owner]
        same = np.maximum(groups - differ - (g - np.bincount(owner[sent], minlength=rows)), 1)
        # all groups that two sets share may be empty ones, at least groups - differ of them: those two
        # meet in one of the first few of either's empty groups by number
        none = np.flatnonzero(count == 0)
        empty = np.bincount(owner[none], minlength=rows)
        spare = np.where(live, empty - (groups - differ), -1)
        nth = np.arange(len(none)) - (np.cumsum(empty) - empty)[owner[none]]
        first = none[nth <= spare[owner[none]]]
        keys += [key[sent], with_level(X.mix(salt[first] ^ U64(0x5851F42D4C957F2D)), level[owner[first]])]
        owners += [owner[sent], owner[first]]
        least_shared += [same[owner[sent]], same[owner[first]]]
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(least_shared)


class RTree:
    """Bulk loaded R-tree over points of group counts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        order = np.lexsort((points[:, 1], points[:, 0], sizes)) if len(points) else np.empty(0, np.int64)
        # tiles by size, then by the coordinate with the widest spread in each tile
        tile = max(FANOUT, int(math.sqrt(max(1, len(points)) * FANOUT)))
        parts = []
        for i in range(0, len(order), tile):
            part = order[i : i + tile]
            wide = int(np.argmax(points[part].std(axis=0)))
            parts.append(part[np.argsort(points[part][:, wide], kind="stable")])
        self.order = np.concatenate(parts) if parts else order
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # upper corners, least sizes; leaves' parents first
        top, least = self.points, self.sizes
        while len(top) > FANOUT:
            cut = np.arange(0, len(top), FANOUT)
            top, least = np.maximum.reduceat(top, cut, axis=0), np.minimum.reduceat(least, cut)
            self.levels.append((top, least))

    def query(self, point: np.ndarray, size: int, among: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the points (of those flagged in ``among``) whose bound reaches the overlap they need, best bound first."""
        if among is not None and among.sum() * FANOUT <= len(self.sizes):
            at = np.flatnonzero(among[self.order])  # few are left: the tree saves nothing
        else:
            at = np.arange(len(self.levels[-1][1]) if self.levels else len(self.sizes))
            for i in reversed(range(len(self.levels))):
                top, least = self.levels[i]
                bound = np.minimum(top[at], point).sum(axis=1)
                at = at[bound >= need(size, least[at], self.percent)]
                below = self.levels[i - 1][1] if i else self.sizes
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(below)]
            if among is not None:
                at = at[among[self.order[at]]]
        if not len(at):
            return at
        bound = np.minimum(self.points[at], point).sum(axis=1)
        ok = bound >= need(size, self.sizes[at], self.percent)
        return self.order[at[ok][np.argsort(-bound[ok], kind="stable")]]


def count_points(sets: list[np.ndarray], dimensions: int = DIMENSIONS) -> np.ndarray:
    out = np.zeros((len(sets), dimensions), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((X.mix(s) % U64(dimensions)).astype(np.int64), minlength=dimensions)
    return out


def join_sets(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, asking: int | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Verified links; unless ``every``, only those that join components anew.

    label: components known before; asking: only the first so many sets ask.
    """
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    points = count_points(sets)
    tree = RTree(points, sizes, percent)
    label = np.arange(len(sets)) if label is None else label.copy()
    asking = len(sets) if asking is None else asking
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    own = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    links = []
    for q in range(asking):
        c = tree.query(points[q], int(sizes[q]), None if every else label != label[q])
        c = c[(c > q) | (c >= asking)] if every else c
        c = c[c != q]
        if not len(c):
            continue
        mine = flat[start[q] : start[q] + sizes[q]]
        own[mine] = 1
        cut = np.append(np.flatnonzero(np.diff(np.cumsum(sizes[c]) // COMPARED)) + 1, len(c))
        for i, j in zip(np.append(0, cut), cut):  # a bounded number of shingles at a time, the best bounds first
            d = c[i:j] if every else c[i:j][label[c[i:j]] != label[q]]
            if not len(d):
                continue
            both = np.add.reduceat(own[flat[X.ranges(start[d], sizes[d])]], np.cumsum(sizes[d]) - sizes[d])
            d = d[100 * both >= percent * (sizes[d] + sizes[q] - both)]
            if not every and len(d):
                # one link to each component that is met
                joined_, first = np.unique(label[d], return_index=True)
                d = d[first]
                label[np.isin(label, joined_)] = label[q]
            links += [(q, int(p)) for p in d]
        own[mine] = 0
    return links


def _sets(k: int, buf, offs):
    w = X.Words(buf, offs)
    row, x = X.shingles(w, k)
    n, ref = set_hash(row, x, w.rows)
    return row, x, n, ref.view(np.int64)


def classes(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(doc_id, tie, n_shingles, ref, point): ref names the set, tie the text; point: group counts where sets can differ and link."""

    def run(batches):
        for b in batches:
            buf, offs = X.column(b, 2)
            for i, j in X.slices(offs, SLICE_BYTES):
                row, x, n, ref = _sets(k, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                end = np.cumsum(n)
                for p in range(0, j - i, 4096):
                    q = min(p + 4096, j - i)
                    a, z = int(end[p] - n[p]), int(end[q - 1])
                    at = (row[a:z] - p) * DIMENSIONS + (X.mix(x[a:z]) % U64(DIMENSIONS)).astype(np.int64)
                    point = np.bincount(at, minlength=(q - p) * DIMENSIONS).reshape(q - p, DIMENSIONS)
                    point[(point > 65535).any(axis=1)] = 65535  # more than fits: the bound lets it pass
                    point = point.astype(np.uint16)
                    points = [point[r].tobytes() if n[p + r] > 1 else None for r in range(q - p)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i + p, q - p), b.column(1).slice(i + p, q - p), pa.array(n[p:q]), pa.array(ref[p:q]), pa.array(points, pa.binary())], names=["doc_id", "tie", "n_shingles", "ref", "point"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).cast("string").alias("text")).mapInArrow(X.tidy(run), f"doc_id {kind}, tie bigint, n_shingles bigint, ref bigint, point binary")


def planes(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: of sorted ones the upper planes hardly weigh anything."""
    return squeeze(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.copy())


def from_planes(blob, kind) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(swell(blob, np.uint8).reshape(n, -1).T).view(kind).ravel()


def met(keys: np.ndarray, refs: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, ref, shared) without repetition, by key; and how many refs each row's key has."""
    order = np.lexsort((refs, keys))
    keys, refs, shared = keys[order], refs[order], shared[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (refs[1:] != refs[:-1])
    keys, refs, shared = keys[new], refs[new], shared[new]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(first) - 1
    return keys, refs, shared, np.bincount(group)[group] if len(keys) else group


def common_signatures(docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """(ref, key, shared) of every signature that at least two classes have; see signatures() for shared.

    Signatures travel packed to shards of their key space.  Of a key that many
    classes of one flush have, one goes there and the others are known to share
    it: a shard gets no more of a key than ``LOCAL`` a flush.
    """
    shards = 4 * runtime.shuffle_partitions(docs.sparkSession)
    layout = Layout(percent)

    def emit(keys, refs, shared):
        key, ref, least, n = met(np.concatenate(keys), np.concatenate(refs), np.concatenate(shared))
        least = np.minimum(least, 65535).astype(np.uint16)
        lead = np.ones(len(key), dtype=bool)
        lead[1:] = key[1:] != key[:-1]
        crowd = n > LOCAL
        goes = ~crowd | lead
        where = np.where(goes, exchange.shard_of(key << U64(64 - HASH_BITS - 8), shards), exchange.shard_of(X.mix(ref.view(U64)), shards))
        order = np.argsort(where, kind="stable")
        at = np.searchsorted(where[order], np.arange(shards + 1))
        some = np.flatnonzero(at[1:] > at[:-1])
        own = lambda x, s: x[order[at[s] : at[s + 1]]]
        flag = np.where(goes, np.where(crowd, 1, 0), 2).astype(np.uint8)
        cols = [pa.array([f(own(x, s)) for s in some], pa.binary()) for f, x in ((planes, key), (lambda x: x.tobytes(), ref), (planes, least), (squeeze, flag))]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *cols], names=["shard", "key", "ref", "shared", "flag"])

    def run(batches):
        keys, refs, shared, held = [], [], [], 0
        for b in batches:
            buf, offs = X.column(b, 0)
            for i, j in X.slices(offs, SLICE_BYTES):
                row, x, n, ref = _sets(k, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                owner, key, least = signatures(row, x, n, layout)
                keys.append(key)
                refs.append(ref[owner])
                shared.append(least)
                held += len(key)
                if held >= FLUSH:
                    yield emit(keys, refs, shared)
                    keys, refs, shared, held = [], [], [], 0
        if held:
            yield emit(keys, refs, shared)

    def meet(group: pa.Table) -> pa.Table:
        key, ref, least, flag = (np.concatenate([f(x.as_buffer(), kind) for x in group.column(c)]) for c, f, kind in (("key", from_planes, U64), ("ref", np.frombuffer, np.int64), ("shared", from_planes, np.uint16), ("flag", swell, np.uint8)))
        passed = flag == 2  # known to be shared; the key's own shard is another
        crowd = np.unique(key[flag == 1])
        mine_key, mine_ref, mine_least, n = met(key[~passed], ref[~passed], least[~passed])
        keep = (n > 1) | (X.lookup(crowd, mine_key) >= 0)
        out = [np.concatenate([a[keep], b[passed]]) for a, b in ((mine_key, key), (mine_ref, ref), (mine_least, least))]
        return pa.table({"ref": pa.array(out[1]), "key": pa.array(out[0].view(np.int64)), "shared": pa.array(out[2].astype(np.int32))})

    sent = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(X.tidy(run), "shard int, key binary, ref binary, shared binary, flag binary")
    return sent.groupBy("shard").applyInArrow(X.tidy_group(meet), "ref bigint, key bigint, shared int")


def candidates(docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """Candidate edges (a, b, lev) between classes that share enough group signatures of a size level.

    Classes that link have ``shared`` keys of a level in common.  So a class with
    fewer common keys has no link there, and of one with more the last shared - 1
    keys, in one order for all, may be left out: the first key that two classes
    share is among what both keep.
    """
    common, _ = runtime.written(common_signatures(docs, text, k, percent), "signatures")
    level = F.col("key").bitwiseAND(F.lit(255))
    sets = common.groupBy("ref", level.alias("lev")).agg(F.collect_set("key").alias("keys"), F.max("shared").alias("shared"))
    left = F.expr("slice(array_sort(keys), 1, size(keys) - shared + 1)")
    kept, _ = runtime.written(sets.filter(F.size("keys") >= F.col("shared")).select("ref", "lev", F.explode(left).alias("key")), "kept")
    # aggregates are written before they are joined back, so that a key of many rows can be split in the join
    lead, _ = runtime.written(kept.groupBy("key").agg(F.min("ref").alias("a"), F.max("ref").alias("most")).filter("a != most").select("key", "a"), "leads")
    return kept.join(lead, "key").filter("ref != a").select("a", F.col("ref").alias("b"), "lev").distinct()


def grouped(pairs: DataFrame) -> DataFrame:
    """(ref, lev, grp): classes that candidate edges of one level connect."""
    pairs, _ = runtime.written(pairs.distinct(), "pairs")
    node = lambda c: F.xxhash64(c, "lev")
    comp = runtime.components(pairs.select(node("a").alias("a"), node("b").alias("b")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("ref"), "lev").distinct().withColumn("node", node("ref"))
    return ends.join(comp, "node").select("ref", "lev", F.col("root").alias("grp"))


def parted(groups: DataFrame, sets: DataFrame, percent: int, most: int = PARTED) -> DataFrame:
    """(ref, grp): groups cut into what the bound on overlaps connects; classes without a partner fall out.

    Every task has the points of one group, and up to ``most`` of its classes ask there.
    """
    counts, _ = runtime.written(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "sizes")
    sized = groups.join(counts, "grp")
    points = sets.filter("point is not null").groupBy("ref").agg(F.first("n_shingles").alias("n"), F.first("point").alias("point"))
    slices = F.expr(f"cast(ceil(size / {most}) as int)")
    dealt = sized.join(points, "ref").withColumn("mine", F.expr("cast(pmod(xxhash64(ref), {0}) as int)".format(f"cast(ceil(size / {most}) as bigint)"))).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))

    def ask(group: pa.Table) -> pa.Table:
        ref, n = group.column("ref").to_numpy(), group.column("n").to_numpy()
        p = np.frombuffer(b"".join(x.as_buffer() for x in group.column("point")), np.uint16).reshape(len(ref), DIMENSIONS).astype(np.int32)
        tree, label = RTree(p, n, percent), np.arange(len(ref))
        for q in np.flatnonzero(group.column("mine").to_numpy() == group.column("slice")[0].as_py()).tolist():
            reached = np.unique(label[tree.query(p[q], int(n[q]), label != label[q])])
            if len(reached):
                label[np.isin(label, reached) | (label == label[q])] = min(int(reached[0]), int(label[q]))
        b = np.flatnonzero(label != np.arange(len(ref)))
        lev = np.full(len(b), group.column("lev")[0].as_py())
        return pa.table({"a": pa.array(ref[label[b]]), "b": pa.array(ref[b]), "lev": pa.array(lev, pa.int64())})

    edges = dealt.groupBy("grp", "slice").applyInArrow(X.tidy_group(ask), "a bigint, b bigint, lev bigint")
    return grouped(edges).select("ref", "grp")


_MEMBER = "grp bigint, chunk int, ref bigint, blob binary"


def members(docs: DataFrame, text: str, k: int, labels: DataFrame, chunk: int) -> DataFrame:
    """(grp, chunk, ref, blob) of every class in each of its candidate groups; a class may come once a task."""
    spark = docs.sparkSession
    sizes, _ = runtime.written(labels.groupBy("grp").agg(F.sum(F.col("n") + SET).alias("size")), "sizes")
    placed = labels.join(sizes, "grp").select("ref", "grp", F.expr(f"cast(pmod(xxhash64(ref), cast(ceil(size / {chunk}) as bigint)) as int)").alias("chunk"))
    placed, _ = runtime.written(placed, "placed")
    total = placed.count()
    few = total <= BROADCAST_LABELS
    table = None
    if few:
        t = placed.toArrow()
        ref, grp, ch = (t.column(c).to_numpy() for c in ("ref", "grp", "chunk"))
        order = np.argsort(ref)
        table = spark.sparkContext.broadcast((ref[order], grp[order], ch[order].astype(np.int32)))

    def run(batches):
        known, grp, ch = table.value if table is not None else (None, None, None)
        seen: set[int] = set()
        for b in batches:
            buf, offs = X.column(b, 0)
            for i, j in X.slices(offs, SLICE_BYTES):
                row, x, n, ref = _sets(k, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                at = X.lookup(known, ref) if known is not None else np.where(n > 0, 0, -1)
                start = np.cumsum(n) - n
                out = []
                for r in np.flatnonzero((at >= 0) & (n > 0)).tolist():
                    name = int(ref[r])
                    if name in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(name)
                    own = x[start[r] : start[r] + n[r]].tobytes()
                    p = int(at[r])
                    if known is None:
                        out.append((0, 0, name, own))
                    while known is not None and p < len(known) and known[p] == name:
                        out.append((int(grp[p]), int(ch[p]), name, own))
                        p += 1
                if out:
                    g, c, f, blob = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int32()), pa.array(f, pa.int64()), pa.array(blob, pa.binary())], names=["grp", "chunk", "ref", "blob"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(X.tidy(run), _MEMBER)
    if not few:
        found = found.select("ref", "blob").join(placed, "ref").select("grp", "chunk", "ref", "blob")
    return found


def _load(group: pa.Table):
    ref = group.column("ref").to_numpy()
    ref, first = np.unique(ref, return_index=True)
    blobs = group.column("blob")
    return ref, [np.frombuffer(blobs[int(i)].as_buffer(), U64) for i in first]


def _edges(ref, links) -> pa.Table:
    a = np.array([ref[i] for i, _ in links], np.int64)
    b = np.array([ref[j] for _, j in links], np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def joined(found: DataFrame, percent: int, every: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between classes that connect every component; all links if ``every``."""

    def alone(group: pa.Table) -> pa.Table:
        ref, sets = _load(group)
        return _edges(ref, join_sets(sets, percent, every=every))

    spark = found.sparkSession
    found, _ = runtime.written(found, "members")
    edges, _ = runtime.written(found.groupBy("grp", "chunk").applyInArrow(X.tidy_group(alone), "a bigint, b bigint"), "links")
    large = found.filter("chunk > 0").select("grp").distinct()
    large, _ = runtime.written(large, "large")
    if large.isEmpty():
        return edges
    # groups of several chunks: components so far, then representatives, then the exact rest;
    # identifiers find out what is left to do before any sets travel
    rest, _ = runtime.written(found.join(large, "grp", "left_semi").dropDuplicates(["grp", "ref"]), "large_members")
    ids = rest.select("grp", "chunk", "ref", (F.length("blob") / 8 + SET).cast("long").alias("weight"))

    def labelled(e):
        comp = runtime.components(e)
        return ids.join(comp, ids["ref"] == comp["node"], "left").select("grp", "chunk", "ref", "weight", F.coalesce("root", "ref").alias("root"))

    lab = ids.withColumn("root", F.col("ref"))
    if not every:
        before = None
        for _ in range(8):
            lab, _ = runtime.written(labelled(edges), "labelled")
            counts = lab.filter("ref = root").groupBy("grp").agg(F.sum("weight").alias("size"), F.count(F.lit(1)).alias("sets")).filter("sets > 1").drop("sets")
            now = tuple(counts.agg(F.count(F.lit(1)), F.sum("size")).collect()[0])
            if not now[0] or now == before:
                break
            before = now
            dealt = lab.filter("ref = root").join(counts, "grp").select("grp", "ref", F.expr(f"cast(pmod(xxhash64(ref), cast(ceil(size / {chunk}) as bigint)) as int)").alias("deal"))
            reps = rest.join(dealt, ["grp", "ref"]).select("grp", F.col("deal").alias("chunk"), "ref", "blob")
            more, _ = runtime.written(reps.groupBy("grp", "chunk").applyInArrow(X.tidy_group(alone), "a bigint, b bigint"), "links")
            if more.isEmpty():
                break
            edges = edges.unionAll(more)
    sizes = lab.groupBy("grp", "root").agg(F.sum("weight").alias("size"))
    main = sizes.groupBy("grp").agg(F.max_by("root", "size").alias("main"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    lab, _ = runtime.written(lab.join(main, "grp").select("grp", "ref", "root", "main", "total"), "apart")
    if lab.isEmpty():
        return edges
    lab = rest.join(lab, ["grp", "ref"])
    # those outside a group's largest component are asked against all its other members, block by block
    asks = lab.filter("root != main").withColumn("block", F.expr(f"cast(pmod(xxhash64(ref), cast(ceil(total / {chunk}) as bigint)) as int)"))
    blocks = F.expr(f"cast(ceil(total / {chunk}) as int)")
    asked = lab.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("asks", F.lit(False)).select("grp", "chunk", "block", "ref", "blob", "root", "asks")
    chunks = ids.select("grp", "chunk").distinct().groupBy("grp").agg(F.collect_set("chunk").alias("chunk"))
    asks = asks.drop("chunk").join(chunks, "grp").withColumn("chunk", F.explode("chunk")).withColumn("asks", F.lit(True)).select("grp", "chunk", "block", "ref", "blob", "root", "asks")

    def across(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        ref, root = group.column("ref").to_numpy(), group.column("root").to_numpy()
        order = np.lexsort((ref, ~asks))
        _, first = np.unique(ref[order], return_index=True)
        keep = order[np.sort(first)]
        asking = int(asks[keep].sum())
        blobs = group.column("blob")
        sets = [np.frombuffer(blobs[int(i)].as_buffer(), U64) for i in keep]
        return _edges(ref[keep], join_sets(sets, percent, root[keep], asking, every=every))

    last = asked.unionAll(asks).groupBy("grp", "chunk", "block").applyInArrow(X.tidy_group(across), "a bigint, b bigint")
    last, _ = runtime.written(last, "links")
    return edges.unionAll(last)


def link_classes(docs: DataFrame, *, text: str = "text", k: int = 3, percent: int = 90, every: bool = False, chunk: int = CHUNK, sets: DataFrame | None = None, parted_most: int = PARTED) -> DataFrame:
    """Verified links (a, b) between set classes (refs)."""
    if sets is None:
        sets, _ = runtime.written(classes(docs, text, text, k), "classes")
    groups, _ = runtime.written(grouped(candidates(docs, text, k, percent)), "candidates")
    known = sets.filter("n_shingles > 0").groupBy("ref").agg(F.first("n_shingles").alias("n"))
    labels, _ = runtime.written(parted(groups, sets, percent, parted_most).join(known, "ref"), "parted")
    found = members(docs, text, k, labels, chunk)
    return joined(found, percent, every, chunk)


def rooted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90, **options) -> DataFrame:
    """(doc_id, tie, n_shingles, root) of every row; equal roots: one component."""
    before = runtime.mark()
    sets, _ = runtime.written(classes(docs, doc_id, text, k), "classes")
    links = link_classes(docs, text=text, k=k, percent=percent, sets=sets, **options)
    comp = runtime.components(links)
    out = sets.join(comp, sets["ref"] == comp["node"], "left").select("doc_id", "tie", "n_shingles", F.coalesce("root", "ref").alias("root"))
    out, path = runtime.written(out, "rooted")
    runtime.drop_since(docs.sparkSession, before, path)
    return out


def components_of(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = rooted(docs, **options)
    # written: a join of its own, in which a component of many rows can be split
    least, _ = runtime.written(rows.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, in docs' own columns: the one with the smallest doc_id.

    Rows that repeat id and text are one document; of different texts with one
    id a hash of the text decides; rows without an id are the largest.  Rows
    without shingles stay.
    """
    rows = rooted(docs, doc_id=doc_id, text=text, **options).filter("n_shingles > 0")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    least, _ = runtime.written(rows.groupBy("root").agg(F.min(name).alias("least"), F.max(name).alias("most")).filter("least != most").drop("most"), "least")
    gone = rows.join(least, "root").filter(~name.eqNullSafe(F.col("least"))).select(F.col("doc_id").alias("_gone_id"), F.col("tie").alias("_gone_tie")).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs[text]) == gone["_gone_tie"]), "left_anti")

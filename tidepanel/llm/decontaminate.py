"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items are cut into word sequences and dealt, by a hash, to
blocks of about ``BLOCK_WORDS`` words; a task builds a block's generalised
suffix automaton.  One automaton at a time is broadcast for a map pass over the
documents.  Where there are several blocks, rows and what was found in them are
written to the shared folder between passes, so that no stage ever holds more
than one automaton.
Document words are streamed through the automaton; at every word the longest
suffix that occurs in some item is known, and with it every window that ends
there.  Stretches of a document in which two successive words never follow
each other in any item cannot hold a window of two or more words, and leave
the automaton at its root; they are skipped by a vectorised test.

Words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters.
Null or empty texts have no words.  Items with equal item_id count once; items
without an id mark words but are not listed.  Repeated document rows are
answered once each.  An empty benchmark leaves every document clean, an empty
table gives no rows.  Texts are taken whole, whatever their length.  Columns
beside the text, rows without an id among them, are passed on unchanged; the
result's name must not be one of theirs (remove_contamination() sees to it).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runtime
from . import textops as X

#: words of benchmark text in one broadcast automaton (about 400 bytes a word)
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the windows of each state."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[str | None] = []
        self._texts: list[list[int]] = []

    def add(self, item: str | None, words: list[int]) -> None:
        if not words:
            return
        self.items.append(item)
        self._texts.append(words)
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def finish(self, vocabulary: np.ndarray) -> "SuffixAutomaton":
        """Mark which items' windows each state stands for; build the skip test."""
        n, link, length, win = len(self.next), self.link, self.length, self.window
        order = sorted(range(n), key=length.__getitem__)
        #: the state on v's suffix path that holds its suffix of ``window`` words
        self.holder = [0] * n
        for v in order[1:]:
            self.holder[v] = v if length[link[v]] < win else self.holder[link[v]]
        windows: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for i, words in enumerate(self._texts):
            v = 0
            for k, w in enumerate(words, 1):
                v = self.next[v][w]
                if k >= win:
                    windows.setdefault(self.holder[v], set()).add(i)
            if len(words) < win:
                while length[link[v]] >= len(words):
                    v = link[v]
                whole.setdefault(v, []).append((len(words), i))
        self.windows = windows
        self.whole = whole
        #: nearest state on the suffix path, itself included, that ends a short item; -1: none
        self.short = [-1] * n
        for v in order[1:]:
            self.short[v] = v if v in whole else self.short[link[v]]
        self.least = min((min(len(t), win) for t in self._texts), default=0)
        self.vocabulary = vocabulary
        pairs = {(a << 32) | b for t in self._texts for a, b in zip(t, t[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        del self._texts
        return self

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges [from, to) in order of their ends, and the items' numbers."""
        nxt, link, length, win = self.next, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        v = size = 0
        for i, w in enumerate(words, 1):
            while v and w not in nxt[v]:
                v = link[v]
                size = length[v]
            t = nxt[v].get(w)
            if t is None:
                continue
            v, size = t, size + 1
            if size >= win:
                found |= self.windows.get(self.holder[v], set())
                spans.append((i - win, i))
            u = self.short[v]
            while u > 0:
                for n, item in self.whole[u]:
                    if n <= size:
                        found.add(item)
                        spans.append((i - n, i))
                u = self.short[link[u]]
        return spans, found


def blocks(items: DataFrame, item_id: str, item_text: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata over blocks of items, built by a task each and brought to the driver one at a time."""
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null").distinct()

    def words(batches):
        for b in batches:
            n = [len(w.hash) for w in (X.Words(*X.column(b.slice(r, 1), 1), X.ALNUM) for r in range(b.num_rows))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=["i", "t", "n"])

    def build(group: pa.Table) -> pa.Table:
        texts = []
        for i, t in sorted(zip(group.column("i").to_pylist(), group.column("t").to_pylist()), key=lambda x: (x[0] is not None, x[0] or "", x[1])):
            raw = np.frombuffer(t.encode(), np.uint8)
            texts.append((i, X.Words(raw, np.array([0, len(raw)]), X.ALNUM).hash))
        vocabulary = np.unique(np.concatenate([h for _, h in texts]))
        sam = SuffixAutomaton(window)
        for name, h in texts:
            sam.add(name, np.searchsorted(vocabulary, h).tolist())
        return pa.table({"block": group.column("block")[:1], "automaton": pa.array([pickle.dumps(sam.finish(vocabulary))], pa.binary())})

    counted, counted_path = runtime.written(rows.mapInArrow(X.tidy(words), "i string, t string, n bigint").filter("n > 0"), "items")
    total = counted.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    parts = -(-total // block_words)
    if parts:
        dealt = counted.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int"))
        made, made_path = runtime.written(dealt.groupBy("block").applyInArrow(X.tidy_group(build), "block int, automaton binary"), "automata")
        for k in range(parts):
            for r in made.filter(F.col("block") == k).select("automaton").collect():
                yield pickle.loads(r["automaton"])
        runtime.delete_path(spark, made_path)
    runtime.delete_path(spark, counted_path)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(sam: SuffixAutomaton | None, buf: np.ndarray, offs: np.ndarray):
    """Per row: number of words, merged hit ranges in words, item names; and the words."""
    words = X.Words(buf, offs, X.ALNUM)
    n = len(words.hash)
    spans: dict[int, list] = {}
    names: dict[int, set] = {}
    if sam is not None and n:
        ids = X.lookup(sam.vocabulary, words.hash)
        joined = np.zeros(n, dtype=bool)  # the word goes on with the next one
        if n > 1:
            ok = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (words.row[:-1] == words.row[1:]))
            joined[ok] = X.lookup(sam.pairs, (ids[ok] << 32) | ids[ok + 1]) >= 0
        before = np.concatenate([[False], joined[:-1]])
        start = np.flatnonzero((ids >= 0) & ~before)
        end = np.flatnonzero((ids >= 0) & ~joined) + 1
        long = end - start >= sam.least
        for a, b in zip(start[long].tolist(), end[long].tolist()):
            got, found = sam.scan(ids[a:b].tolist())
            if got:
                r = int(words.row[a])
                base = a - int(words.first[r])
                spans.setdefault(r, []).extend((base + x, base + y) for x, y in got)
                names.setdefault(r, set()).update(sam.items[i] for i in found)
    return words, {r: _merge(s) for r, s in spans.items()}, names


_SPAN = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
_RESULT = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
_PA_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _passes(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, block_words: int, result: str, finish) -> DataFrame:
    """Every block in turn; the last pass hands its rows to ``finish`` or returns docs with the column ``result``."""
    spark, out = docs.sparkSession, docs
    at_hand = None  # one automaton is kept back, to know the last
    for sam in blocks(items, item_id, item_text, window, block_words):
        if at_hand is not None:
            shared = spark.sparkContext.broadcast(at_hand)
            out, _ = runtime.written(_pass(out, docs.schema, text, shared, result), "contamination")
            shared.destroy()
        at_hand = sam
    return _pass(out, docs.schema, text, spark.sparkContext.broadcast(at_hand) if at_hand is not None else None, result, finish)


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS, result: str = "contamination") -> DataFrame:
    """docs with a struct column ``result``: n_words, spans (in words), items.

    One map pass a block of the benchmark; no shuffle of documents.
    """
    return _passes(docs, items, text, item_id, item_text, window, block_words, result, None)


def _pass(docs: DataFrame, own: T.StructType, text: str, shared, result: str, finish=None) -> DataFrame:
    """One block's automaton over docs, whose own columns ``own`` are; what earlier blocks found is added up.

    finish(batch, words, spans by row): own columns of the rows that stay.
    """
    schema = own if finish else T.StructType([*own.fields, T.StructField(result, T.StructType(_RESULT))])
    names, before = own.names, result in docs.columns and result not in own.names

    def run(batches):
        sam = shared.value if shared is not None else None
        for whole in batches:
            at = whole.schema.get_field_index(text)
            if not whole.num_rows:
                continue
            buf_all, offs_all = X.column(whole, at)
            for i, j in X.slices(offs_all):
                batch = whole.slice(i, j - i)
                buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
                words, spans, found = _hits(sam, buf, offs)
                if before:
                    for r, old in enumerate(batch.column(batch.schema.get_field_index(result)).to_pylist()):
                        if old["spans"]:
                            spans[r] = _merge(spans.get(r, []) + [(x["from"], x["to"]) for x in old["spans"]])
                            found.setdefault(r, set()).update(old["items"])
                cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
                if finish:
                    yield finish(pa.RecordBatch.from_arrays(cols, names=names), buf, words, spans)
                    continue
                made = pa.StructArray.from_arrays(
                    [
                        pa.array(np.diff(words.first), pa.int64()),
                        pa.array([[{"from": a, "to": b} for a, b in spans.get(r, [])] for r in range(j - i)], _PA_SPANS),
                        pa.array([sorted(x for x in found.get(r, ()) if x is not None) for r in range(j - i)], pa.list_(pa.string())),
                    ],
                    names=["n_words", "spans", "items"],
                )
                yield pa.RecordBatch.from_arrays([*cols, made], names=[*names, result])

    return docs.mapInArrow(X.tidy(run), schema)


def hit_words(result: str = "contamination") -> Column:
    return F.aggregate(F.col(f"{result}.spans"), F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])


def report(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document with counts and a digest of the items found."""
    found = find_contamination(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, text="text", **options)
    names = F.col("contamination.items")
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("contamination.spans") > 0).alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", length: str | None = "n_chars", min_span: int = 1, max_coverage: float = 0.5, item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, in their own columns, without what they share with the benchmark.

    Spans of at least ``min_span`` hit words, whole short items among them, are
    cut out of the text (with the bytes between their first and last word); a
    document of whose words more than ``max_coverage`` is hit is dropped.  Others
    are returned unchanged.  The column ``length``, where there is one, gets the
    new number of characters.
    """
    result = "contamination"
    while result in docs.columns:
        result = f"_{result}"

    def cut(batch, buf, words, spans):
        n = np.diff(words.first)
        texts, sizes = {}, {}
        stays = np.ones(batch.num_rows, dtype=bool)
        for r, own in spans.items():
            if sum(b - a for a, b in own) > max_coverage * n[r]:
                stays[r] = False
                continue
            long = [x for x in own if x[1] - x[0] >= min_span]
            if long:
                text_at, base = batch.column(batch.schema.get_field_index(text))[r].as_py().encode(), int(words.offs[r])
                first, left, parts = int(words.first[r]), 0, []
                for a, b in long:
                    parts.append(text_at[left : int(words.start[first + a]) - base])
                    left = int(words.end[first + b - 1]) - base
                texts[r] = b"".join([*parts, text_at[left:]]).decode()
                sizes[r] = len(texts[r])
        cols = list(batch.columns)
        for name, new in ((text, texts), (length, sizes)):
            at = batch.schema.get_field_index(name) if name else -1
            if new and at >= 0:
                cols[at] = pa.array([new.get(r, x) for r, x in enumerate(cols[at].to_pylist())], cols[at].type)
        out = pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
        return out if stays.all() else out.filter(pa.array(stays))

    return _passes(docs, items, text, item_id, item_text, window, block_words, result, cut)

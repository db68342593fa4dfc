import hashlib

import numpy as np
import pyarrow as pa
import pytest
import reference as ref
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_model_operators import Taken, most_held

from tidepanel.llm import decontaminate, exact_dedup, ngram_join, runtime, suffix_dedup
from tidepanel.llm import textops as X


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ \t\n\x0b-é日_09", max_size=30), min_size=1, max_size=6))
def test_words(texts):
    for table, words in ((X.SPACED, ref.spaced), (X.ALNUM, ref.alnum)):
        buf, offs = buffers(texts)
        w = X.Words(buf, offs, table)
        got = [[] for _ in texts]
        low = X.lower(buf).tobytes()
        for r, a, b in zip(w.row, w.start, w.end):
            got[r].append(low[a:b].decode())
        assert got == [words(t) for t in texts]
        names = {}
        for r, a, b, h in zip(w.row, w.start, w.end, w.hash):
            assert names.setdefault(int(h), low[a:b]) == low[a:b]
        assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=25), min_size=1, max_size=6), st.integers(1, 5))
def test_shingles(texts, k):
    buf, offs = buffers(texts)
    row, x = X.shingles(X.Words(buf, offs), k)
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(ref.shingle_set(t, k)) for t in texts]


# operator 1


def test_suffix_array_orders_and_prefixes():
    r = np.random.default_rng(0)
    text = r.integers(97, 99, 300).astype(np.uint8)
    size = np.array([120, 80, 100])
    begin = np.cumsum(size) - size
    sa = suffix_dedup.SuffixArray(text, begin, size, 20)
    ends = np.repeat(begin + size, size)
    suffix = [text[i : min(i + 20, ends[i])].tobytes() for i in range(300)]
    assert [suffix[i] for i in sa.order] == sorted(suffix)
    lcp = sa.common_prefixes(np.arange(300))
    place = {int(p): n for n, p in enumerate(sa.order)}
    for i in range(300):
        n = place[i]
        if n:
            a, b = suffix[sa.order[n - 1]], suffix[i]
            want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[i] == want
    windows = np.stack([text[i : i + 10] for i in (0, 50, 121)] + [np.full(10, 122, np.uint8)])
    hit = sa.find(windows, 10)
    assert hit[3] == -1 and all(suffix[sa.order[h]][:10] == w.tobytes() for h, w in zip(hit[:3], windows))


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_repeated_bytes(spark, hard_texts, block):
    texts = hard_texts + [prose(9, 60) + " " + hard_texts[6][100:330], hard_texts[6][200:310], "ab" * 150, "x" * 130]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = suffix_dedup.report(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), block=block)
    want = ref.byte_repeats(docs)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_kasai_with_ties(seed):
    """Strings that repeat to the depth and beyond; only some positions asked for."""
    r = np.random.default_rng(seed)
    part = r.integers(97, 100, 70).astype(np.uint8)
    text = np.concatenate([part, part[10:], np.full(90, 97, np.uint8), part, r.integers(97, 98 + seed, 200).astype(np.uint8)])
    size = np.array([100, 120, len(text) - 220])
    begin = np.cumsum(size) - size
    sa = suffix_dedup.SuffixArray(text, begin, size, 25)
    ends = np.repeat(begin + size, size)
    at = np.sort(r.choice(len(text), 260, replace=False))
    place = np.empty(len(text), int)
    place[sa.order] = np.arange(len(text))
    for i, got in zip(at.tolist(), sa.common_prefixes(at).tolist()):
        if place[i]:
            j = int(sa.order[place[i] - 1])
            most = min(25, ends[i] - i, ends[j] - j)
            assert got == next((k for k in range(most) if text[i + k] != text[j + k]), most)


def test_repeats_in_long_periodic_texts(spark):
    """Megabytes of one, two or forty characters over and over: all but a first period goes."""
    unit = prose(31, 20)[:41]
    texts = ["-" * 3_000_000, "-=" * 1_000_000, unit * 40_000, " " * 500, "-" * 700]
    out = {r["doc_id"]: r for r in suffix_dedup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)).collect()}
    kept = ["-", "-=", unit, " ", ""]
    for i, (t, k) in enumerate(zip(texts, kept)):
        assert (out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"]) == (len(t), len(t) - len(k), 1)
        assert out[i]["kept_sha256"] == hashlib.sha256(k.encode()).hexdigest()


def test_repeated_bytes_edges(hard, nothing, nameless):
    out = suffix_dedup.report(hard).collect()
    assert len(out) == hard.count()
    assert len({tuple(r) for r in out if r["doc_id"] == 6}) == 1  # a repeated row is the same document
    assert suffix_dedup.report(nothing).count() == 0
    got = suffix_dedup.report(nameless).collect()
    assert len(got) == 4 and [r["n_removed"] for r in got if r["doc_id"] is None and r["n_bytes"]] == [0]


# operator 3


def test_join_against_brute_force(spark, hard_texts):
    r = np.random.default_rng(2)
    texts = list(hard_texts)
    for b in range(6):
        words = prose(20 + b, 40 + 30 * b).split()
        for _ in range(6):
            v = list(words)
            for k in r.integers(0, len(v), r.integers(0, 4)):
                v[k] = f"new{r.integers(1000)}"
            texts.append(" ".join(v))
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    for k, percent, chunk in ((3, 90, 1 << 20), (5, 80, 1 << 20), (3, 90, 1500)):
        got = ngram_join.components_of(df, k=k, percent=percent, chunk=chunk)
        assert rows(got) == sorted(ref.near_components(docs, k, percent), key=str)


@pytest.mark.parametrize(("percent", "size"), [(80, n) for n in (4, 10, 20, 45, 80, 160, 320, 640)] + [(90, 12), (90, 200)])
def test_signatures_meet_and_are_not_shared_by_chance(percent, size):
    """Sets at the similarity share a key; no key joins many sets that have nothing in common."""
    r = np.random.default_rng(size)
    layout = ngram_join.Layout(percent)

    def keys(sets):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        owner, key, shared = ngram_join.signatures(rows, np.concatenate([np.sort(s) for s in sets]), np.array([len(s) for s in sets]), layout)
        least = {(i, v): c for i, v, c in zip(owner.tolist(), (key & np.uint64(255)).tolist(), shared.tolist())}
        return [set(key[owner == i].tolist()) for i in range(len(sets))], least

    def meet(a, b):
        (x, y), least = keys([a, b])
        level = lambda s, v: sorted(k for k in s if k & 255 == v)
        both = [v for v in {k & 255 for k in x & y} if len(set(level(x, v)) & set(level(y, v))) >= max(least[0, v], least[1, v])]
        # what the filter leaves of each: the first keys in one order
        left = [set(level(s, v)[: len(level(s, v)) - least[n, v] + 1]) for v in both for n, s in ((0, x), (1, y))]
        return any(left[i] & left[i + 1] for i in range(0, len(left), 2))

    draw = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    apart, _ = keys([draw(size) for _ in range(400)])
    counts = np.unique(np.concatenate([list(k) for k in apart if k] or [[0]]), return_counts=True)[1]
    assert counts.max() <= 0.04 * 400
    for _ in range(200):
        whole = draw(size + size // 4)
        a, b = whole[: size], r.permutation(whole)[: len(whole) - int(r.integers(0, 1 + size // 8))]
        both = len(np.intersect1d(a, b))
        if len(a) != both != len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            assert meet(a, b)
        # exactly at the similarity: as many changed as it lets
        least = ngram_join.need(size, size, percent)
        c = np.concatenate([a[:least], draw(size - least)])
        assert least == size or meet(a, c)


def test_join_keeps_a_large_group_whole(spark):
    words = prose(50, 150).split()
    texts = [" ".join(w if i != k else f"v{k}" for i, w in enumerate(words)) for k in range(90)] + [" ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = ngram_join.components_of(df, chunk=6000).collect()
    want = {i: c for i, _, c in ref.near_components(list(enumerate(texts)))}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_all_links(spark):
    words = prose(60, 100).split()
    texts = [" ".join(w if i not in (k, 2 * k) else "q" for i, w in enumerate(words)) for k in range(1, 12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [ref.shingle_set(t, 3) for t in texts]
    want = sum(100 * len(a & b) >= 90 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert ngram_join.link_classes(df, every=True).distinct().count() == want


def test_join_edges(hard, nothing, nameless):
    out = ngram_join.components_of(hard).collect()
    assert len(out) == hard.count() and ngram_join.components_of(nothing).count() == 0
    got = ngram_join.components_of(nameless).collect()
    assert sorted(str(r["component_id"]) for r in got if r["n_shingles"]) == ["4", "4", "4"]
    kept = ngram_join.deduplicate(hard)
    assert kept.columns == hard.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for _, n, c in ref.near_components([(r["doc_id"], r["text"]) for r in hard.collect()]) if n} | {r["doc_id"] for r in hard.collect() if not ref.spaced(r["text"])}
    assert set(ids) == want
    assert {r["text"] for r in ngram_join.deduplicate(nameless).collect()} == {r["text"] for r in nameless.collect()}
    assert ngram_join.deduplicate(nameless).count() == 3


def test_signature_task_holds_little(monkeypatch, spark):
    docs, texts = Taken(), [prose(i, 400, 30_000) for i in range(2000)]
    docs.sparkSession, docs.applyInArrow = spark, lambda run, schema: docs
    ngram_join.common_signatures(docs, "text", 5, 80)
    most, out = most_held(docs.run([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    assert out and most < 60


def test_workers_are_sent_few_bytes_at_a_time(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    docs = spark.range(200).select(F.repeat(F.col("id").cast("string"), 50_000).alias("text")).coalesce(1)
    got = runtime.written(docs.mapInArrow(sizes, "n long, bytes long"), "sizes")[0].collect()
    assert sum(r["n"] for r in got) == 200 and max(r["bytes"] for r in got) < 5e6
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before



def test_components_by_shuffles(spark):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    small = {x["node"]: x["root"] for x in runtime.components(df).collect()}
    large = {x["node"]: x["root"] for x in runtime.components(df, one_task=0).collect()}
    assert small == large and large[1040] == 1000


# operator 6


def test_exact(hard, hard_texts, nothing, nameless):
    got = exact_dedup.report(hard).collect()
    assert len(got) == len(hard_texts) + 1
    groups = {}
    for i, t in [*enumerate(hard_texts), (6, hard_texts[6])]:
        groups.setdefault((t or "").translate(ref.LOW), []).append(i)
    for key, ids in groups.items():
        own = [r for r in got if r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()]
        assert sorted(r["doc_id"] for r in own) == sorted(ids)
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(max(ids), len(ids))}
        assert sum(r["kept"] for r in own) == 1
    assert exact_dedup.report(nothing).count() == 0
    kept = exact_dedup.deduplicate(hard)
    assert kept.columns == hard.columns and kept.count() == len(groups)
    assert {r["keep_id"] for r in exact_dedup.report(nameless).collect() if r["group_size"] == 2} == {4}


def test_exact_over_deliveries(spark, tmp_path):
    """A second delivery meets the state that the first left, and full bytes at its locators."""
    def delivery(name, rows):
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    first = delivery("one", [(1, "A b"), (2, "a B"), (3, "other"), (9, None)])
    second = delivery("two", [(4, "a b"), (5, "other"), (0, "OTHER"), (6, "new"), (7, "")])
    weak = lambda c: F.substring(c, 1, 1)
    for digest, home in ((exact_dedup.sha256, "strong"), (weak, "weak")):
        state = str(tmp_path / home)
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.report(first, state=state, digest=digest).collect()}
        assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 9: (9, 1)}
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.report(second, state=state, digest=digest).collect()}
        assert got == {4: (4, 3, True), 5: (5, 3, True), 0: (5, 3, False), 6: (6, 1, True), 7: (9, 2, False)}
        third = delivery(f"three-{home}", [(8, "anew"), (10, "A B")])
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.report(third, state=state, digest=digest).collect()}
        assert got == {8: (8, 1), 10: (10, 4)}


def test_exact_checks_full_bytes(hard):
    weak = lambda c: __import__("pyspark.sql.functions", fromlist=["x"]).substring(exact_dedup.sha256(c), 1, 1)
    strong = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.report(hard).collect()}
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.report(hard, digest=weak).collect()} == strong


def test_exact_state_goes_over_batches(hard):
    one = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.report(hard).collect()}
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.report(hard, files_per_batch=1).collect()} == one


# operator 7

ITEMS = [(1, " ".join(f"w{i}" for i in range(30))), (2, " ".join(f"w{i}" for i in range(5, 20))), (10, "short one here"), (11, "Solo"), (12, None), (13, ""), (None, "no name item " * 4), (2, " ".join(f"w{i}" for i in range(5, 20)))]


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_contamination(spark, block_words):
    texts = [None, "", "solo", "a SOLO b solo", "short one here again short one", "x " + ITEMS[0][1] + " y", " ".join(f"w{i}" for i in range(7, 16)), " ".join(f"w{i}" for i in range(7, 17)), "w1 w2 w3", ITEMS[6][1], "short-one.here " + ITEMS[1][1].upper(), prose(3, 500)]
    docs = list(enumerate(texts)) + [(5, texts[5])]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows(decontaminate.report(d, i, block_words=block_words)) == sorted(ref.contamination(docs, ITEMS), key=str)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 4), max_size=40))
def test_automaton(items, doc):
    sam = decontaminate.SuffixAutomaton(4)
    for n, t in enumerate(items):
        sam.add(str(n), t)
    sam.finish(np.arange(4, dtype=np.uint64))
    spans, found = sam.scan(doc)
    want_hit, want = set(), set()
    for n, t in enumerate([t for t in items if t]):
        k = min(4, len(t))
        for p in range(len(t) - k + 1):
            for q in range(len(doc) - k + 1):
                if doc[q : q + k] == t[p : p + k]:
                    want_hit.update(range(q, q + k))
                    want.add(n)
    assert {x for a, b in spans for x in range(a, b)} == want_hit and found == want


def test_contamination_edges(spark, hard, nothing):
    i = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(hard, i).count() == hard.count() and decontaminate.report(nothing, i).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(hard, none).collect())
    mixed = spark.createDataFrame([(1, "clean words stay", "en", "s", 3, "", ""), (2, ITEMS[0][1], "en", "s", 3, "", ""), (3, prose(4, 60) + " " + ITEMS[1][1] + ", end", "en", "s", 3, "", ""), (4, None, "en", "s", None, "", "")], hard.schema)
    out = {r["doc_id"]: r for r in decontaminate.remove_contamination(mixed, i).collect()}
    assert set(out) == {1, 3, 4} and out[1]["text"] == "clean words stay" and out[4]["text"] is None
    assert out[3]["text"] == prose(4, 60) + " , end" and out[3]["n_chars"] == len(out[3]["text"])

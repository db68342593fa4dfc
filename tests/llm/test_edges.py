"""Every operator and every pipeline stage on one table of hard rows, and on an empty one.

Rows: no id, repeated rows, one id with two texts, null and empty texts, equal
texts (ties), texts of several hundred kilobytes with and without blanks, and
columns whose names the operators use themselves.
"""

import hashlib
import zlib

import public_tokenizers
import pytest
import reference as ref
from conftest import prose
from tokenizers import Tokenizer

from tidepanel.llm import bloom_lm, decontaminate, exact_dedup, ngram_join, packing, pii, quality, suffix_dedup, toxicity, warc

corpus_pipeline = pytest.importorskip("corpus_pipeline")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, entities string, contamination string, locator string, ref string, root string, record_type string"
ITEMS = [(1, prose(900, 30)), (2, "tiny item"), (None, prose(901, 12)), (3, None)]


def table():
    base = prose(70, 90)
    long = " ".join(prose(s, 2000) for s in range(71, 96))  # some 300 KB
    texts = [(1, base), (2, base), (2, base.upper()), (None, base), (None, None), (3, None), (4, ""), (5, " \t\n"), (6, long), (7, long + " more"), (8, "x" * 300_000), (9, "x" * 300_000 + "y"), (10, prose(70, 40) + " " + ITEMS[0][1]), (11, "Mr Otto Lang, +49 30 1234567, a tiny item"), (12, "идиот 日本語 " * 40)]
    texts += [(20 + i, prose(100 + i, 60)) for i in range(80)]
    own = ["own"] * 7
    rows = [(i, t, ["en", None, "de"][(i or 0) % 3], "s", None if t is None else len(t), *own) for i, t in texts]
    return rows + [rows[0], rows[4], rows[8]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    spark.createDataFrame(table(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(20 + i, 1, int(i % 9 == 0)) for i in range(80)] + [(None, 1, 1), (20, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


PAIRS = [r[:2] for r in table()]
DISTINCT = list(dict.fromkeys(PAIRS))


def test_op1(docs, nothing):
    """Repeated rows are one document, rows without an id the earliest; equal ids in some fixed order."""
    out = [tuple(r) for r in suffix_dedup.report(docs).collect()]
    assert len(out) == len(PAIRS) and {r[0]: r[1] for r in out}[8] == 300_000
    # x repeated: all but its first byte goes, in the next document all but its last byte too
    assert {r[2:4] for r in out if r[0] == 8} == {(299_999, 1)} and {r[2:4] for r in out if r[0] == 9} == {(300_000, 1)}
    named = [(i, t) for i, t in DISTINCT if i is not None and (i not in (2, 8, 9))]
    none = [(-1, PAIRS[0][1])]  # the only row without an id that has a text
    want = ref.byte_repeats([*none, *named])
    got = {r[0]: r[1:5] for r in out if r[0] not in (None, 2, 8, 9)}
    assert got == {i: want[i] for i, _ in named}


def test_op2(docs):
    out = pii.replace(docs, key=b"k", result="found")
    assert out.columns == [*docs.columns, "found"] and out.count() == len(PAIRS)
    by = {r["doc_id"]: r for r in out.collect()}
    assert [s["kind"] for s in by[11]["found"]] == ["called", "family", "phone"] and "Lang" not in by[11]["text"]
    assert by[6]["text"] == dict(PAIRS)[6] and by[3]["text"] is None


def test_op3(docs):
    assert rows(ngram_join.components_of(docs)) == sorted(ref.near_components(PAIRS), key=str)


def test_op4(docs, folder, spark):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.report(docs, labels).collect()
    assert len(out) == len(PAIRS) and all(r["kept"] and r["perplexity"] is None for r in out if not r["n_bytes"])
    assert {r["n_bytes"] for r in out if r["doc_id"] == 8} == {300_000}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_op5(docs):
    out = bloom_lm.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == sorted((str(i), len(ref.spaced(t)) + 1) for i, t in PAIRS)
    assert all(r["held_out"] != ref.in_training(r["doc_id"], 10) for r in out)


def test_op6(docs):
    low = lambda t: (t or "").translate(ref.LOW)
    out = exact_dedup.report(docs).collect()
    members = {}
    for i, t in PAIRS:
        members.setdefault(low(t), []).append(i)
    want = sorted(((i, max((x for x in members[low(t)] if x is not None), default=None), len(members[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in PAIRS), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=str) == want
    assert sum(r["kept"] for r in out) == len(members)


def test_op7(docs, folder, spark):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert rows(decontaminate.report(docs, items)) == sorted(ref.contamination(PAIRS, ITEMS), key=str)
    out = {r["doc_id"]: r["text"] for r in decontaminate.remove_contamination(docs, items).collect()}
    assert out[11] == "Mr Otto Lang, +49 30 1234567, a " and out[10].strip() == prose(70, 40)


def test_op8(docs, folder, spark):
    out = toxicity.report(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert len(out) == len(PAIRS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (3, 4, 5)}) == 1


def test_op9(docs):
    library = Tokenizer.from_file(PATH)
    out = packing.report(docs, PATH).collect()
    lengths = {}
    for r in out:
        lengths.setdefault((r["doc_id"], r["piece"]), set()).add((r["start"], r["length"], r["ids_crc32"]))
    for i, t in ((8, "x" * 300_000), (6, dict(PAIRS)[6])):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        own = sorted((next(iter(v)) for k, v in lengths.items() if k[0] == i))
        assert sum(n for _, n, _ in own) == len(ids) and all(n == 1024 for _, n, _ in own[1:])
        for start, n, crc in own:
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + n])) == crc
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 1024


def test_op10(spark, docs):
    pages = docs.selectExpr("doc_id AS page_id", "'http://h/' || coalesce(cast(doc_id AS string), '') AS url", "text AS html", "record_type", "ref AS run")
    out = warc.report(pages).collect()
    groups = {}
    for i, t in PAIRS:
        groups.setdefault(t or "", []).append(i)
    for r in out:
        assert r["payload_bytes"] in {len((t or "").encode()) for i, t in PAIRS if i == r["page_id"]}
    first = {hashlib.sha1(t.encode()).hexdigest(): max((i for i in ids if i is not None), default=None) for t, ids in groups.items() if len(t.encode()) >= 1000}
    assert len(out) == len(PAIRS)
    for r in out:
        f = first.get(r["payload_digest"], r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if f == r["page_id"] else ("revisit", f))


def test_stages(spark, folder, docs):
    """Each stage alone, on the hard rows and on none, in documents' columns but for the last."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == corpus_pipeline.STAGES[-1][0]:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {i for i, _ in PAIRS}
        else:
            assert out.columns == docs.columns
            kept = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
            assert {i for i, _ in kept} >= {20 + i for i in range(80) if name != "quality_classifier"}
            if name in ("exact_dedup", "ngram_join"):
                assert set(kept) <= set(PAIRS) and {i for i, _ in kept if i in (6, 7)} == ({6} if name == "ngram_join" else {6, 7})

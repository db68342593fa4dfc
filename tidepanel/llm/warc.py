"""WARC archives with an externally merged capture index.

Pages become WARC/1.0 records written by Spark's own text writer, so archives
can lie in any store that Spark reaches.  Of records with equal payloads of at
least ``least`` bytes the one with the largest page_id is a response and the
others are revisit records that hold HTTP headers only and refer to it; payloads
are equal by digest and length, and those that then meet are compared in full.
The archives are read back as whole files of a bounded number of records and,
large records going to archives of their own size class, of bytes; each gives a
locally sorted run of captures.  Runs stay as they are sorted: they are cut at the
bounds of URL-key ranges, a range gets the packed pieces of all runs, and a loser
tree merges these k ways by URL key, timestamp and id.  Ranges are bounded in
captures, also within one URL; in order they are one globally ordered capture
history.

A null html is an empty payload, a null url an empty one.  Rows that repeat the
page_id and payload of a response are responses too.  Null page_ids are smaller
than any other.  An empty table gives no archive and no rows; columns beside
page_id, url and html are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from . import textops as X

LEAST_BYTES = 1000
RECORDS_PER_FILE = 1000
#: bytes of an archive: a record of more has one to itself
FILE_BYTES = 128 << 20
#: captures that one task merges
RANGE = 50_000
#: digests that more than one page has, broadcast up to this number (about 60 bytes each)
BROADCAST_DIGESTS = 500_000
_NL = "\r\n"


class LoserTree:
    """k-way merge of sorted iterators: each step replays one leaf's path of losers."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = k = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * k  # losers at 1..k-1, the winner at 0
        for leaf in range(k):
            self._replay(leaf, build=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x[0], a) < (y[0], b)

    def _replay(self, leaf: int, build: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                if build:
                    self.tree[node] = winner
                    return
            elif self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while True:
            w = self.tree[0]
            item = self.head[w]
            if item is None:
                return
            yield item
            self.head[w] = next(self.runs[w], None)
            self._replay(w)


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: reversed host, port, path, sorted query; no fragment."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url
    host = host.removeprefix("www.")
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (u.path.lower() or "/") + (f"?{query.lower()}" if query else "")


def with_decisions(pages: DataFrame, least: int = LEAST_BYTES, digest=F.sha1) -> DataFrame:
    """page_id, url, html and payload_bytes, payload_digest, refers_to (null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": digest(F.col("html").cast("binary"))}
    )
    same = (
        rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    same, _ = runtime.written(same, "originals")
    few = same.count() <= BROADCAST_DIGESTS
    known = F.broadcast(same) if few else same
    # those that share a digest are compared in full, after a map-side combine: a group of any size sends one payload a task
    both = ["payload_digest", "payload_bytes"]
    differ = rows.filter(F.col("payload_bytes") >= least).join(known.select(*both), both, "left_semi").groupBy(*both).agg(F.min("html").alias("a"), F.max("html").alias("b")).filter("a != b").select(*both)
    differ, _ = runtime.written(differ, "collisions")
    joined = rows.join(known, both, "left")
    if not differ.isEmpty():
        clash = rows.join(F.broadcast(differ), both, "left_semi")
        apart = clash.join(clash.groupBy("html").agg(F.max("page_id").alias("first")), "html").select(*joined.columns)
        joined = joined.join(F.broadcast(differ), both, "left_anti").unionByName(apart)
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def record(captured: Column) -> Column:
    """The WARC record of a row without the separator that ends it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_NL}Content-Type: text/html; charset=utf-8{_NL}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(_NL + _NL),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.0{_NL}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{_NL}WARC-Target-URI: "), url,
        F.lit(f"{_NL}WARC-Date: "), captured,
        F.lit(f"{_NL}WARC-Record-ID: <urn:capture:"), _text(F.col("page_id")), F.lit(">"),
        F.when(revisit, F.concat(F.lit(f"{_NL}WARC-Refers-To: <urn:capture:"), _text(F.col("refers_to")), F.lit(f">{_NL}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit(f"{_NL}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{_NL}Content-Type: application/http; msgtype=response{_NL}Content-Length: "),
        (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.octet_length("html"))).cast("string"),
        F.lit(_NL + _NL), block,
    )


def default_date() -> Column:
    """Pages carry no capture time: one second for each id after a fixed start."""
    at = F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(10**9)))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, *, least: int = LEAST_BYTES, captured: Column | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives below path, a folder for each size class of records: eight times larger ones go an eighth as many to a file."""
    smallest = FILE_BYTES // records_per_file
    kind_of = lambda size: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / smallest) / 3)).cast("int")
    kinds = {r["kind"] for r in pages.select(kind_of(F.coalesce(F.octet_length("html"), F.lit(0))).alias("kind")).distinct().collect()}  # a few powers of eight
    rows = with_decisions(pages, least).withColumn("kind", kind_of(F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(F.lit(0))))
    for k in sorted(kinds and kinds | {0}):
        (
            rows.filter(F.col("kind") == k).select(record(captured if captured is not None else default_date()).alias("value"))
            .write.option("lineSep", _NL + _NL).option("maxRecordsPerFile", max(1, records_per_file >> (3 * k))).text(f"{path}/size={k}")
        )


_END = re.compile(b"\r\n\r\n")


def parse(content) -> Iterator[dict]:
    """Records of one archive, payloads checked against their digests; nothing of it is copied."""
    view, at, end = memoryview(content), 0, len(content)
    while at < end:
        head = _END.search(view, at).start()
        lines = bytes(view[at:head]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        body, size = head + 4, int(fields["Content-Length"])
        http = _END.search(view, body, body + size).start()
        declared = int(next(x for x in bytes(view[body:http]).split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        payload = view[http + 4 : body + size]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and (len(payload) != declared or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of the record at byte {at} does not match its digest")
        yield {"type": fields["WARC-Type"], "url": fields["WARC-Target-URI"], "date": fields["WARC-Date"], "id": fields["WARC-Record-ID"][13:-1], "refers_to": fields["WARC-Refers-To"][13:-1] if "WARC-Refers-To" in fields else None, "digest": digest, "payload_bytes": declared, "offset": at, "length": body + size - at, "payload": payload}
        at = body + size + 4


_INDEX = "run string, url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_offset bigint, record_length bigint"
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def _key(r: tuple):
    return (r[1], r[2], r[3] is not None, r[3] or 0, r[8])


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures an archive."""
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    number = lambda x: None if x in (None, "null") else int(x)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [
                    (name.rsplit("/", 1)[-1], url_key(r["url"]), r["date"], number(r["id"]), r["payload_bytes"], r["digest"], r["type"], number(r["refers_to"]), r["offset"], r["length"])
                    for r in parse(content.as_buffer())
                ]
                rows.sort(key=_key)
                yield _batch(rows, _SCHEMA)

    return archives.mapInArrow(X.tidy(run), _INDEX)


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _INDEX.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    url, date, page, offset = (batch.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "record_offset"))
    return [(u, d, p is not None, p or 0, o) for u, d, p, o in zip(url, date, page, offset)]


def bounds(runs: DataFrame, captures: int) -> list[tuple]:
    """Lower bounds of key ranges of about so many captures, but the first: the least keys of Spark's range partitions."""
    n = runs.count()
    parts = max(runtime.shuffle_partitions(runs.sparkSession), -(-n // captures))
    key = [F.col("url_key"), F.col("captured"), F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), F.col("record_offset")]
    keys = runs.select(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(key))).alias("k")).repartitionByRange(parts, "k")
    least = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min("k").alias("k")).collect()  # one row a range
    return sorted(tuple(r["k"]) for r in least)[1:]


def merge_runs(runs: DataFrame, captures: int = RANGE) -> DataFrame:
    """Captures in global order of (range, position): runs, each sorted, merged range by range."""
    edges = bounds(runs, captures)

    def cut(batches):
        for b in batches:
            run = b.column("run").to_pylist()
            key = _keys(b)
            out = []
            i = 0
            while i < b.num_rows:  # as long as it stays in one run and range: a sorted piece
                r = bisect.bisect_right(edges, key[i])
                j = i + 1
                while j < b.num_rows and run[j] == run[i] and (r == len(edges) or key[j] < edges[r]):
                    j += 1
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b.slice(i, j - i))
                out.append((r, sink.getvalue()))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([x.to_pybytes() for _, x in out], pa.binary())], names=["range", "piece"])

    def merge(group: pa.Table) -> pa.Table:
        pieces = [pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks() for x in group.column("piece")]
        start = 0
        runs_, tables = [], []
        for p in pieces:
            runs_.append(zip(_keys(p.to_batches()[0]), range(start, start + p.num_rows)))
            tables.append(p)
            start += p.num_rows
        order = [place for _, place in LoserTree(runs_)]
        whole = pa.concat_tables(tables).take(pa.array(order, pa.int64()))
        n = whole.num_rows
        return whole.append_column("range", pa.array([group.column("range")[0].as_py()] * n, pa.int32())).append_column("position", pa.array(range(n), pa.int64()))

    dealt = runs.mapInArrow(X.tidy(cut), "range int, piece binary")
    return dealt.groupBy("range").applyInArrow(X.tidy_group(merge), f"{_INDEX}, range int, position bigint")


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write pages as archives under path, read them back, and return the merged index."""
    spark = pages.sparkSession
    path = path or runtime.new_path(spark, "archives")
    write_archives(pages, path, **options)
    if not runtime.exists(spark, path):
        return spark.createDataFrame([], f"{_INDEX}, range int, position bigint")
    runs, _ = runtime.written(index_runs(spark, path), "runs")
    return merge_runs(runs)


def report(pages: DataFrame, **options) -> DataFrame:
    return archive(pages, **options).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
    )

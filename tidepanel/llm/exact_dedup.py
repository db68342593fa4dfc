"""Stateful streaming exact deduplication.

A ledger row is made for every document: SHA-256 of the normalised text, the
document's identifier and a locator (file and row number) of its content.  The
ledger is read as a stream into a keyed aggregation whose state is kept by the
RocksDB state store, on disk, without watermark or expiry: per digest the
identifier and locator of the row that stays, and the number of rows.  Digests
that were hit more than once are then checked on full bytes: the texts of a
digest are compared after a map-side combine, so that a group of any size sends
one text a task; digests whose texts differ are split by their bytes.

With a ``state`` folder the ledger, the stream's checkpoint and its state last:
each call is one more delivery, whose rows are told apart from all deliveries
before.  Full bytes of earlier rows are then read where their locators say.

Normalised: A-Z lower-cased, all else unchanged; null counts as empty.  Of
equal texts the row with the largest doc_id stays (null is the smallest); of
rows that repeat this doc_id too, the one whose locator sorts last.  An empty
table gives no rows; other columns than id and text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

#: state on disk; deltas are checkpointed, and no file is allocated ahead of its content
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: digests of hit groups that may be broadcast (64 bytes each); beyond it they are joined by a shuffle
BROADCAST_DIGESTS = 500_000


def normalised(text: str | Column) -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def with_locator(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, locator); rows that no file holds are written to the shared folder first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    columns = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    try:
        out = docs.select(*columns, place.alias("locator"))
        out.schema  # analysed here
    except AnalysisException:
        held, _ = runtime.written(docs.select(*columns), "documents")
        out = held.select("doc_id", "text", place.alias("locator"))
    return out


def keyed_state(spark: SparkSession, ledger_path: str, schema, files_per_batch: int, state: str | None = None) -> DataFrame:
    """Run the ledger's new files through the stateful stream; the last state of each digest so far."""
    home = state or runtime.new_path(spark, "stream")
    classes, log = f"{home}/classes", f"{home}/checkpoint"
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(ledger_path)
        held = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))

        def sink(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{classes}/batch={number}")  # a batch that is run again replaces its rows

        query = (
            held.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", log).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    batches = spark.read.schema(f"digest string, keep struct<doc_id: {schema['doc_id'].dataType.simpleString()}, locator: struct<file: string, row: bigint>>, group_size bigint, batch int").parquet(classes)
    # a digest that later batches touch again has one row a batch; counts only grow
    last = F.max_by(F.struct("keep", "group_size"), "batch").alias("s")
    return batches.groupBy("digest").agg(last).select("digest", "s.keep", "s.group_size")


def at_locators(spark: SparkSession, rows: DataFrame, text: str) -> DataFrame:
    """rows (digest, doc_id, locator) with the normalised text that lies at their locators."""
    files = [r[0] for r in rows.select("locator.file").distinct().collect()]  # files, not rows
    if not files:
        return rows.withColumn("norm", F.lit(""))
    held = spark.read.parquet(*files).select(normalised(text).alias("norm"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    return rows.join(held, rows["locator"] == held["at"]).drop("at")


def classify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest=sha256, files_per_batch: int = 1000, state: str | None = None) -> DataFrame:
    """One row per document: doc_id, locator, keep (doc_id, locator), group_size, text_sha256."""
    spark = docs.sparkSession
    base = with_locator(docs, doc_id, text)
    rows = base.select("doc_id", "locator", digest(normalised("text")).alias("digest"))
    earlier = None
    if state is None:
        ledger, path = runtime.written(rows, "ledger")
    else:
        path, number = f"{state}/ledger", uuid.uuid4().hex
        if runtime.exists(spark, path):
            earlier, _ = runtime.written(spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path), "earlier")
        rows.write.parquet(f"{path}/delivery={number}")
        ledger = spark.read.schema(rows.schema).parquet(f"{path}/delivery={number}")
        path = f"{path}/*"
    classes, _ = runtime.written(keyed_state(spark, path, ledger.schema, files_per_batch, state), "state")
    hit = classes.filter("group_size > 1").select("digest")
    if earlier is not None:  # digests of this delivery
        hit = hit.join(ledger.select("digest").distinct(), "digest", "left_semi")
    if hit.count() <= BROADCAST_DIGESTS:
        hit = F.broadcast(hit)
    texts = base.select("doc_id", "locator", normalised("text").alias("norm")).withColumn("digest", digest(F.col("norm"))).join(hit, "digest", "left_semi")
    if earlier is not None:
        texts = texts.unionByName(at_locators(spark, earlier.join(hit, "digest", "left_semi"), text).select(*texts.columns))
    differ = (
        texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
        .filter("a != b").select("digest")
    )
    differ, _ = runtime.written(differ, "collisions")
    if differ.isEmpty():
        return ledger.join(classes, "digest").select("doc_id", "locator", "keep", "group_size", F.col("digest").alias("text_sha256"))
    # different texts under one digest: classes of their bytes take the place of its class
    clash = texts.join(F.broadcast(differ), "digest", "left_semi")
    split = clash.groupBy("norm").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    apart = clash.join(split, "norm").select("doc_id", "locator", "keep", "group_size", F.col("digest").alias("text_sha256"))
    if earlier is not None:
        apart = apart.join(ledger.select("locator"), "locator", "left_semi").select("doc_id", "locator", "keep", "group_size", "text_sha256")
    same = ledger.join(differ, "digest", "left_anti").join(classes, "digest")
    return same.select("doc_id", "locator", "keep", "group_size", F.col("digest").alias("text_sha256")).unionByName(apart)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    return classify(docs, **options).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("locator") == F.col("keep.locator")).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, in docs' own columns."""
    names = docs.columns
    held, _ = runtime.written(docs, "documents")
    tag = "locator"
    while tag in names:
        tag = f"_{tag}"
    dropped = classify(held, doc_id=doc_id, text=text, **options).filter("locator != keep.locator").select(F.col("locator").alias(tag))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return held.select("*", place.alias(tag)).join(dropped, tag, "left_anti").select(*names)

"""Session helpers: the shared folder, lineage cuts, bounded broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent on one machine (tests) a local folder is
    made, once a session; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: tables that were written and not dropped yet
_tables: list[str] = []


#: what a Python worker is sent at a time while a table is written: ten thousand rows, the default, can be any number of bytes
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    before = spark.conf.get(BATCH[0], None)
    spark.conf.set(*BATCH)
    try:
        w.parquet(path)
    finally:
        spark.conf.unset(BATCH[0]) if before is None else spark.conf.set(BATCH[0], before)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def mark() -> int:
    return len(_tables)


def drop_since(spark: SparkSession, since: int, *keep: str) -> None:
    """Delete the tables written after mark(), but those in ``keep``: what was made of them must be written or on the driver."""
    old, _tables[since:] = _tables[since:], [p for p in _tables[since:] if p in keep]
    for path in old:
        if path not in keep:
            delete_path(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: edges that one task solves; more are solved by shuffles
ONE_TASK_EDGES = 1_000_000


def _union(batches):
    """Components of all edges of one task by pointer jumping."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Connected components of an undirected graph of long vertex ids.

    Up to ``one_task`` distinct edges are solved in a single task.  Beyond it
    large-star and small-star steps alternate over the edge table; each step is
    a pair of shuffles over edges only, and each round is checkpointed.
    Every vertex that has an edge is returned once as (node, root), root being
    the smallest id of its component.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    e = checkpointed(e)
    if e.count() <= one_task:
        return checkpointed(e.coalesce(1).mapInArrow(X.tidy(_union), "node bigint, root bigint"))
    before = None
    for _ in range(max_rounds):
        # large star: each node sends its larger neighbours to its smallest neighbour or itself
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("l"))
        large = (
            both.filter(F.col("m") > F.col("n")).join(low, "n")
            .select(F.col("m").alias("u"), F.col("l").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        )
        # small star: each node links its smaller neighbours and itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("l"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("l").alias("v"))
            .filter(F.col("u") != F.col("v")).distinct()
        )
        e = checkpointed(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)

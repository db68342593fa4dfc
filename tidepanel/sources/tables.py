"""Sources and sinks: anything tabular to a DataFrame, and results to files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_dataframe(data, spark: SparkSession | None = None) -> DataFrame:
    """A Spark or pandas DataFrame, an Arrow table, a dict of columns or a list of row dicts."""
    if isinstance(data, DataFrame):
        return data
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if isinstance(data, dict) and data and all(hasattr(c, "__len__") and not isinstance(c, str) for c in data.values()):
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame(data))
    if isinstance(data, list) and data and all(isinstance(r, dict) for r in data):
        return spark.createDataFrame(data)
    if type(data).__module__.split(".")[0] in ("pandas", "pyarrow") and hasattr(data, "shape"):
        return spark.createDataFrame(data)
    raise TypeError(f"not a table: {type(data).__name__}")


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A file or folder of any format that Spark reads; CSV has a header and typed columns."""
    if format == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(format).options(**options).load(path)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def describe(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).summary() if columns else df.summary()


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every two of the columns, in one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(cells).alias("p")).select("p.*")


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", **options) -> None:
    df.write.format(format).mode(mode).options(**options).save(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir); a local one only without a cluster."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="shared-")
    return f"{shared.rstrip('/')}/scratch/{uuid.uuid4().hex}"

"""A training-corpus pipeline of five stages over the documents table.

Each stage is a function of (spark, docs, sf_dir); run() writes every stage's
rows as Parquet in the shared folder and reads them again for the next.  All take
texts whole, pass extra columns on whatever their names (but the last, which
returns pieces), and return no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import decontaminate, exact_dedup, ngram_join, packing, quality, queries, runtime


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of trusted text does not reject.

    Null and empty texts stay, as do rows at the threshold; rows that repeat are judged alike.
    """
    return quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id, no id being the smallest; null is as empty.

    Of rows that repeat id and text one stays.
    """
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join: five words, similarity 0.8; the smallest id stays, no id being the largest.

    Rows without words stay; rows that repeat id and text are one document and stay together.
    """
    return ngram_join.deduplicate(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with the benchmark; those that are mostly such passages go.

    Null and empty texts stay unchanged, rows that repeat are treated alike.
    """
    return decontaminate.remove_contamination(docs, queries.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in packed sequences.

    Null and empty texts are an end token each; rows that repeat, or have no id, are packed each.
    """
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: no SQL expresses the language model, the tokens or the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = runtime.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

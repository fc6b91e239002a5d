"""Keyword list and labelled corpus files (SRC-02, SRC-05, SNK-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import normalise_keywords


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: one keyword per line, trimmed, blank lines dropped."""
    return normalise_keywords(spark.read.text(path).select(F.col("value").alias("keyword")))


def write_split_corpus(split: DataFrame, path: str) -> None:
    """SNK-06: the labelled corpus with ``split`` as the partition column."""
    split.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-05: one frame, ``split`` recovered from the folder (a filter on it prunes folders)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df

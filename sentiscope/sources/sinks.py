"""Sinks (SNK-01..05): append, publish as a version of a manifest.

Parquet has no MERGE and a job never reads and overwrites the same path: a publish writes its rows
once, as a new segment, and then the manifest that names it (``segments``), which is the switch that
readers see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..schemas import conform
from . import segments


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """SNK-01/02: bag append; no dedup here (see ``ingest.new_only``). Rows are clustered by the partition column, so a
    task writes few folders; a large one is split over several tasks again."""
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("append").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def publish(df: DataFrame, root: str, schema: T.StructType | None = None) -> str | None:
    """SNK-03/04/05 with FLT-11 and D18: ``df`` becomes the whole served table.

    The rows are computed and written once. Only a version that holds rows is committed, by a manifest
    that appears as a whole, so a reader of ``serving()`` sees either the old or the new version, never a
    half-replaced table, wherever the driver dies. Returns the version's path, or None when nothing
    was published and the old version stays.
    """
    if schema is not None:
        df = conform(df, schema)
    made = segments.replace(df, root, df.schema)
    return None if made is None else f"{root}/{made.live[0].path}"


def serving(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The served table: the last published version."""
    return segments.read(spark, root, schema)

"""Connected components of an edge table by alternating large and small stars.

Each round is two group-bys and joins on the edge table; nothing but the round's row
count and checksum reaches the driver. Labels are the smallest node of each component.
A hub's edges meet its minimum through a partial aggregate and a join, which adaptive
execution splits, so no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentiscope.session import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (both.where("v > u").join(least, "u").where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    up = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another; the root is among them."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u != v").distinct())
    e = _written(e, "edges")
    sums = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = tuple(e.agg(*sums).first())
    while before[0]:
        e = _written(_small(_large(e)), "edges")
        now = tuple(e.agg(*sums).first())
        if now == before:
            break
        before = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))

"""Ingest: keyword search, high-water marks, dedup on append (FLT-07/08, JON-05..07, AGG-20, SET-01).

The keyword match (JON-06) is a containment test of every keyword against every
post, by the walk over prefixes of ``operators.keywords``: what is formed is the (post, keyword) pairs that match
and hardly any other, and lists of any length go the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .keywords import match

REPOST = "^RT @"


def eligible_posts(posts: DataFrame, lang: str | None = "en") -> DataFrame:
    """FLT-07 without the keyword: language and not a repost."""
    cond = ~F.coalesce(F.col("text").rlike(REPOST), F.lit(False))
    if lang is not None:
        cond = cond & (F.col("lang") == lang)
    return posts.where(cond)


def keyword_table(spark, keywords) -> DataFrame:
    """SRC-02 for an in-memory list: trimmed, non-empty, lower case, distinct."""
    lits = F.array(*[F.lit(str(k)) for k in keywords]) if keywords else F.array().cast("array<string>")
    df = spark.range(1).select(F.explode(lits).alias("keyword"))  # JVM-side, no Python task
    return normalise_keywords(df)


def normalise_keywords(df: DataFrame) -> DataFrame:
    k = F.lower(F.trim(F.col("keyword")))
    return df.select(k.alias("keyword")).where(F.length("keyword") > 0).distinct()


def keyword_match(posts: DataFrame, keywords: DataFrame, lang: str | None = "en") -> DataFrame:
    """JON-06 + FLT-07: one row per (keyword, post) where the lower-cased text contains the keyword. Null and
    empty texts contain none; an id that comes in several rows counts once."""
    texts = eligible_posts(posts, lang).select("id", F.lower("text").alias("lc"))
    return match(texts, normalise_keywords(keywords))


def high_water_marks(matched: DataFrame, key: str = "keyword", id_col: str = "id") -> DataFrame:
    """AGG-20 / D7: largest id per keyword, compared as BIGINT (19-digit ids)."""
    return matched.groupBy(key).agg(F.max(F.col(id_col).try_cast("bigint")).alias("last_id"))


def since_marks(rows: DataFrame, marks: DataFrame, key: str, id_col: str) -> DataFrame:
    """FLT-08 + JON-07: keep rows above their key's mark; keys without a mark keep everything."""
    m = marks.select(F.col(key), F.col("last_id").alias("_mark"))
    return (rows.join(m, key, "left")
            .where(F.col("_mark").isNull() | (F.col(id_col).try_cast("bigint") > F.col("_mark")))
            .drop("_mark"))


def new_only(batch: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """JON-05 / D8: in-batch dedup, then drop keys already stored (left anti join).

    Of several copies the largest row stays (by the columns in order, NULL smallest), so
    the answer does not depend on their order. Rows without a key are no copies of each
    other: all stay, to be rejected with a reason later.

    Both sides are reduced to distinct keys first (hash aggregates with map-side
    combine, so a key copied into a third of all rows is one partial row per
    task). AQE can split a skewed partition of the probe side but not of the build
    side; with distinct keys on the build side there is nothing left to split, and
    the anti join reuses the aggregate's hash partitioning on the key.
    """
    return one_per_key(batch, key).join(known.select(key).distinct(), key, "left_anti").select(
        *batch.columns).unionByName(batch.where(F.col(key).isNull()))


def one_per_key(batch: DataFrame, key: str = "id") -> DataFrame:
    """One row of each key, the largest; rows without a key are left out."""
    rest = [c for c in batch.columns if c != key]
    best = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("_r"))
    return best.select(*[F.col(c) if c == key else F.col(f"_r.`{c}`").alias(c) for c in batch.columns])


def union_batches(*batches: DataFrame) -> DataFrame:
    """SET-01: bag union of batches whose columns may differ."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out

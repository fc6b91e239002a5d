"""Search-response landing documents (SRC-01, UDF-04).

A landed page is ``{"meta": {"result_count": n}, "data": [post, ...]}``. Pages
are read with an explicit schema (no inference pass), empty pages are dropped
on ``meta.result_count`` and ``inline`` turns the array into rows, all in one
map-only stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import iso_to_day
from ..schemas import POSTS, SEARCH_RESPONSE, conform

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def read_search_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rows of every non-empty page; ``multi_line`` for pretty-printed single-document files."""
    pages = spark.read.schema(SEARCH_RESPONSE).option("multiLine", multi_line).json(path)
    return (pages.where(F.col("meta.result_count") > 0)
            .select(F.inline("data")))


def posts_from_pages(rows: DataFrame) -> DataFrame:
    """Shape landed rows into the silver post schema (ids as text, day from ``created_at``)."""
    shaped = rows.select(
        F.col("id").cast("string").alias("id"),
        "edit_history_tweet_ids",
        F.col("author_id").cast("string").alias("author_id"),
        "text",
        iso_to_day(F.col("created_at")).alias("date"))
    return conform(shaped, POSTS)


def land_search_pages(posts_text: DataFrame, path: str, page_span: int = 4, lang: str = "en", mode: str = "overwrite") -> None:
    """Write search pages derived from a post table: one page per block of ``page_span`` rows.

    The server-side filter (language) decides what lands in ``data``; a block
    without a match lands as an empty page (``result_count = 0``, no ``data``).
    Blocks are consecutive rows of one task (row position, not key arithmetic),
    so every page holds at most ``page_span`` rows whatever the keys look like
    and the per-page ``collect_list`` is bounded.
    """
    k = F.monotonically_increasing_id()
    post = F.struct(
        F.col("id"), F.col("text"), F.col("author_id"),
        F.date_format(F.col("date").cast("timestamp"), ISO_FORMAT).alias("created_at"),
        F.array(F.col("id")).alias("edit_history_tweet_ids"))
    pages = (posts_text.groupBy(F.floor(k / page_span).alias("page"))
             .agg(F.collect_list(F.when(F.col("lang") == lang, post)).alias("data")))
    n = F.size("data")
    out = pages.select(F.struct(n.cast("long").alias("result_count")).alias("meta"),
                       F.when(n > 0, F.col("data")).alias("data"))
    out.write.mode(mode).option("ignoreNullFields", True).json(path)

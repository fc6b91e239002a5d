"""Review queue: least certain unreviewed predictions (FLT-03, TOP-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def review_queue(posts: DataFrame, threshold: float = 0.8, k: int = 50,
                 texts: DataFrame | None = None) -> DataFrame:
    """Scored, no feedback yet, confidence strictly below ``threshold`` (D13); id breaks ties (D24).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps its
    own k best rows and only those are merged. ``texts`` (id, text) gives the text where
    ``posts`` has none: the k ids are looked up in it, so neither table is shuffled.
    """
    text = F.col("text") if "text" in posts.columns else F.lit(None).cast("string")
    top = (posts.where(F.col("sentiment").isNotNull() & F.col("confidence").isNotNull()
                        & F.col("user_feedback").isNull() & (F.col("confidence") < F.lit(threshold)))
            .select("id", text.alias("text"), "sentiment", "confidence", "user_feedback")
            .orderBy(F.col("confidence").asc(), F.col("id").asc())
            .limit(k))
    if texts is None:
        return top
    found = texts.select("id", F.col("text").alias("_text")).join(F.broadcast(top.select("id")), "id", "left_semi")
    return (top.join(F.broadcast(found), "id", "left")  # at most k posts on either side
            .select("id", F.coalesce("_text", "text").alias("text"), "sentiment", "confidence", "user_feedback"))

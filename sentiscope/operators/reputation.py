"""Daily class counts and the weighted reputation index (AGG-01..04, SCL-07/08).

The reference folds sorted (day, class, count) rows in a Python loop; here the
whole roll-up is one hash aggregation on ``date`` with conditional counts, so
Spark does a map-side partial aggregate and shuffles one row per (day, task).
A day holding a third of all posts is still one small partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Weights of positive, neutral, negative posts in the index.
DEFAULT_WEIGHTS = (2.0, 1.0, 3.0)
CLASSES = ("positive", "negative", "neutral")


def counts_by_day_class(posts: DataFrame) -> DataFrame:
    """AGG-01: posts per (day, class); NULL class is its own group."""
    return posts.groupBy("date", "sentiment").agg(F.count(F.lit(1)).alias("count"))


def class_counts_pivot(posts: DataFrame) -> DataFrame:
    """AGG-02: one row per day with three class counters (pivot over fixed values)."""
    counted = counts_by_day_class(posts).where(F.col("date").isNotNull())
    wide = counted.groupBy("date").pivot("sentiment", list(CLASSES)).agg(F.sum("count"))
    return wide.select(
        "date",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"{c}_count") for c in CLASSES])


def reputation_index(pos: Column, neu: Column, neg: Column, weights=DEFAULT_WEIGHTS) -> Column:
    """(w0*P + w1*N - w2*Neg) / (P+N+Neg), two decimals, 0 when nothing was scored."""
    w0, w1, w2 = (F.lit(float(w)) for w in weights)
    total = pos + neu + neg
    raw = (pos.cast("double") * w0 + neu.cast("double") * w1 - neg.cast("double") * w2) / total.cast("double")
    return F.when(total > 0, F.round(raw, 2)).otherwise(F.lit(0.0))


def class_counts(posts: DataFrame) -> DataFrame:
    """Posts of each class by day (D1-D3); counts of parts of a table add up to its own."""
    s = F.col("sentiment")
    return (posts.where(F.col("date").isNotNull())
            .groupBy("date")
            .agg(F.count_if(s == "positive").alias("positive_count"),
                 F.count_if(s == "negative").alias("negative_count"),
                 F.count_if(s == "neutral").alias("neutral_count")))


def daily_reputation(posts: DataFrame, weights=DEFAULT_WEIGHTS) -> DataFrame:
    """AGG-03: every day with at least one post gets a row (D1); NULL dates are rejects (D2).

    Unscored and unknown classes count nowhere but keep their day (D3).
    """
    return with_index(class_counts(posts), weights)


def with_index(counts: DataFrame, weights=DEFAULT_WEIGHTS) -> DataFrame:
    """Class counts by day with their index."""
    return counts.select(
        "date", "positive_count", "negative_count", "neutral_count",
        reputation_index(F.col("positive_count"), F.col("neutral_count"),
                         F.col("negative_count"), weights).alias("reputation_index"))


def daily_reputation_closed(posts: DataFrame, weights=DEFAULT_WEIGHTS) -> DataFrame:
    """AGG-04: as the reference, the most recent day is left out (it is still open)."""
    daily = daily_reputation(posts, weights)
    # The latest day comes from the date column alone (a metadata-only query when the
    # table is partitioned by date), not from a second run of the roll-up.
    latest = posts.select(F.max("date")).scalar()
    return daily.where(F.col("date") < latest)


def parse_weights(text: Column) -> Column:
    """SCL-08: ``'2,1,3'`` -> array<double>."""
    return F.transform(F.split(F.trim(text), ","), lambda x: F.trim(x).try_cast("double"))


def daily_reputation_weighted_by_text(posts: DataFrame, weights_text: str = "2,1,3") -> DataFrame:
    """Index with weights given as configuration text, parsed inside the plan."""
    w = parse_weights(F.lit(weights_text))
    s = F.col("sentiment")
    counts = (posts.where(F.col("date").isNotNull())
              .groupBy("date")
              .agg(F.count_if(s == "positive").alias("p"),
                   F.count_if(s == "neutral").alias("n"),
                   F.count_if(s == "negative").alias("g")))
    w0, w1, w2 = (F.element_at(w, i) for i in (1, 2, 3))
    total = F.col("p") + F.col("n") + F.col("g")
    raw = (F.col("p").cast("double") * w0 + F.col("n").cast("double") * w1
           - F.col("g").cast("double") * w2) / total.cast("double")
    return counts.select(
        "date", w0.alias("w_positive"), w1.alias("w_neutral"), w2.alias("w_negative"),
        F.when(total > 0, F.round(raw, 2)).otherwise(F.lit(0.0)).alias("reputation_index"))

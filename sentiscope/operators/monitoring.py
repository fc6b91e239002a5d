"""Data behind the monitoring panels.

The reference wraps the time column (``strftime('%s', date) * 1000 BETWEEN``),
which defeats any index. Here every range is a plain inclusive range on the
``date`` (partition column of the silver table) or on ``start_time``, so the
scan is pruned. Top-k panels are ``orderBy(...).limit(k)`` with a unique last
sort key, which Spark runs as a per-task top-k plus one small merge
(``TakeOrderedAndProject``) rather than a global sort.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import bands
from . import reputation as rep


def _d(x) -> F.Column:
    return F.lit(x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)))


def _ts(x) -> F.Column:
    if isinstance(x, dt.datetime):
        return F.lit(x).cast("timestamp_ntz")
    return F.lit(str(x)).cast("timestamp_ntz")


def in_date_range(df: DataFrame, lo, hi, col: str = "date") -> DataFrame:
    """FLT-05: inclusive day range."""
    return df.where(F.col(col).between(_d(lo), _d(hi)))


def in_time_range(df: DataFrame, lo, hi, col: str = "start_time") -> DataFrame:
    """FLT-05 on a time stamp: inclusive."""
    return df.where(F.col(col).between(_ts(lo), _ts(hi)))


def last_n_days(df: DataFrame, n: int, anchor=None, col: str = "date") -> DataFrame:
    """FLT-06: ``anchor - n days <= date <= anchor``; anchor defaults to the latest day present."""
    a = _d(anchor) if anchor is not None else df.select(F.max(col)).scalar()
    return df.where((F.col(col) >= F.date_sub(a, n)) & (F.col(col) <= a))


def post_count_in_range(posts: DataFrame, lo, hi) -> DataFrame:
    """AGG-05 with the panel band (SCL-15)."""
    c = F.count(F.lit(1))
    return in_date_range(posts, lo, hi).agg(
        c.alias("post_count"), bands.band(c, bands.POST_COUNT_STEPS).alias("count_band"))


def class_counts_in_range(posts: DataFrame, lo, hi) -> DataFrame:
    """AGG-06: posts per class, NULL class included."""
    return in_date_range(posts, lo, hi).groupBy("sentiment").agg(F.count(F.lit(1)).alias("count"))


def posts_per_day(posts: DataFrame, lo, hi) -> DataFrame:
    """AGG-07."""
    return in_date_range(posts, lo, hi).groupBy("date").agg(F.count(F.lit(1)).alias("count"))


def reputation_series(daily: DataFrame, lo, hi) -> DataFrame:
    """Panel 'Reputation over time': (date, index, epoch ms) in range, with the day band."""
    return in_date_range(daily, lo, hi).select(
        "date", "reputation_index",
        F.unix_millis(F.col("date").cast("timestamp")).alias("epoch_ms"),
        bands.band(F.col("reputation_index"), bands.DAILY_INDEX_STEPS).alias("index_band"))


def mean_reputation_in_range(daily: DataFrame, lo, hi) -> DataFrame:
    """AGG-08: unweighted mean of the daily values (D17)."""
    return in_date_range(daily, lo, hi).agg(
        F.round(F.avg("reputation_index"), 6).alias("mean_reputation_index"),
        F.count(F.lit(1)).alias("days"))


def mean_confidence_in_range(posts: DataFrame, lo, hi) -> DataFrame:
    """AGG-09: unscored rows (NULL) are left out by ``avg``."""
    return in_date_range(posts, lo, hi).agg(
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.count("confidence").alias("scored_posts"))


def reputation_bands(posts: DataFrame, lo, hi, weights=rep.DEFAULT_WEIGHTS) -> DataFrame:
    """SCL-16: mean index and mean confidence as percent of their range, then bands.

    One pass: per day the class counts plus the confidence sum and count, then a
    second tiny aggregate over the days (mean of daily indexes, pooled confidence).
    """
    s = F.col("sentiment")
    per_day = (in_date_range(posts, lo, hi).where(F.col("date").isNotNull())
               .groupBy("date")
               .agg(F.count_if(s == "positive").alias("p"),
                    F.count_if(s == "neutral").alias("n"),
                    F.count_if(s == "negative").alias("g"),
                    F.sum("confidence").alias("cs"),
                    F.count("confidence").alias("cn")))
    idx = rep.reputation_index(F.col("p"), F.col("n"), F.col("g"), weights)
    both = per_day.agg(F.avg(idx).alias("m"), (F.sum("cs") / F.sum("cn")).alias("c"))
    m, c = F.col("m"), F.col("c")
    ipct = bands.percent_of_range(m, -float(weights[2]), bands.INDEX_MAX)
    cpct = c * F.lit(100.0)
    return both.select(
        F.round(m, 6).alias("mean_reputation_index"),
        F.round(ipct, 4).alias("index_percent"),
        bands.band(ipct, bands.INDEX_PERCENT_STEPS).alias("index_band"),
        F.round(c, 6).alias("mean_confidence"),
        F.round(cpct, 4).alias("confidence_percent"),
        bands.band(cpct, bands.CONFIDENCE_PERCENT_STEPS).alias("confidence_band"))


def latest_negative(posts: DataFrame, lo, hi, k: int = 10) -> DataFrame:
    """TOP-02 with FLT-04: latest negative posts with their text, id breaks ties (D24)."""
    return (in_date_range(posts, lo, hi).where(F.col("sentiment") == "negative")
            .select("author_id", "date", "text", "id")
            .orderBy(F.col("date").desc(), F.col("id").asc()).limit(k))


def sample_posts(posts: DataFrame, lo, hi, k: int | None = None) -> DataFrame:
    """TOP-06: text and class of every post in range; with ``k`` a repeatable sample (md5 order)."""
    rows = in_date_range(posts, lo, hi).select("id", "text", "sentiment")
    if k is None:
        return rows
    return rows.withColumn("_h", F.md5("id")).orderBy("_h", "id").limit(k).drop("_h")


# Display names of the ledger columns in the training table panel.
RUN_RENAMES = {
    "end_time": "End Time",
    "epoch": "Epochs",
    "eval_accuracy": "Accuracy Evaluation",
    "eval_f1": "F1 Evaluation",
    "eval_loss": "Loss Evaluation",
    "eval_runtime": "Evaluation runtime",
    "eval_samples_per_second": "Evaluation sample/s",
    "eval_steps_per_second": "Evaluation steps/s",
    "start_time": "Start time",
}


def latest_training_runs(runs: DataFrame, lo, hi, k: int = 10) -> DataFrame:
    """TOP-03 + PRJ-02/06 + SRT-02: latest ``k`` runs in range, all columns, display names,
    delivered sorted by evaluation speed (ascending) as the panel shows them."""
    top = in_time_range(runs, lo, hi).orderBy(F.col("start_time").desc(), F.col("end_time").desc()).limit(k)
    if "eval_samples_per_second" in runs.columns:
        top = top.orderBy(F.col("eval_samples_per_second").asc(), F.col("start_time").desc())
    return top.withColumnsRenamed({k2: v for k2, v in RUN_RENAMES.items() if k2 in runs.columns})


def positions(delivered: DataFrame) -> DataFrame:
    """SRT-01/02: the rows of a small sorted result with their ``position`` as delivered (from 1)."""
    return delivered.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


def first_rows(df: DataFrame, k: int = 5, key: str = "id") -> DataFrame:
    """TOP-07: the first rows by key, for a log; a top-k of each task, no sort of the table."""
    return df.orderBy(key).limit(k)


def last_training_run(runs: DataFrame, lo, hi) -> DataFrame:
    """TOP-04: the latest run (D14: ordered, not an arbitrary row)."""
    return in_time_range(runs, lo, hi).orderBy(F.col("start_time").desc(), F.col("end_time").desc()).limit(1)


def last_accuracy(runs: DataFrame, lo, hi) -> DataFrame:
    """AGG-10: last non-null accuracy by start time (D15; end time, then the larger value,
    break ties), with the gauge band."""
    r = in_time_range(runs, lo, hi).where(F.col("eval_accuracy").isNotNull())
    order = [c for c in ("start_time", "end_time", "eval_accuracy") if c in runs.columns]
    v = F.max_by("eval_accuracy", F.struct(*order))
    return r.agg(v.alias("last_accuracy"), F.max("start_time").alias("at")).withColumn(
        "accuracy_band", bands.band(F.col("last_accuracy"), bands.ACCURACY_STEPS))


def accuracy_bands(runs: DataFrame, lo, hi) -> DataFrame:
    """SCL-15 per run: accuracy gauge band."""
    return in_time_range(runs, lo, hi).select(
        "start_time", "eval_accuracy",
        bands.band(F.col("eval_accuracy"), bands.ACCURACY_STEPS).alias("accuracy_band"))


def run_metric_series(runs: DataFrame, lo, hi) -> DataFrame:
    """Loss, accuracy and samples/s panels over time."""
    return in_time_range(runs, lo, hi).select(
        "start_time", "eval_loss", "eval_accuracy", "eval_samples_per_second",
        F.unix_millis(F.col("start_time").cast("timestamp")).alias("epoch_ms"))


def train_seconds(runs: DataFrame, lo, hi) -> DataFrame:
    """SCL-12: run duration in whole seconds (the panel's 'time_ms' is seconds, D16)."""
    secs = (F.unix_timestamp(F.col("end_time").cast("timestamp"))
            - F.unix_timestamp(F.col("start_time").cast("timestamp")))
    return in_time_range(runs, lo, hi).select("start_time", secs.cast("long").alias("train_seconds"))

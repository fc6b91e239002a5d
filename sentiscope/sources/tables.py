"""Driver tables and the fixture views derived from them (FIXTURES.md part B).

Each view is a plain projection/join over a parquet table, so filters and
column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def restrict_to_days(table: DataFrame, days: DataFrame, col: str = "date") -> DataFrame:
    """Rows of a day-partitioned table on the days named by ``days``.

    A semi join alone does not prune the scan, so the table is first cut to the
    [min, max] day, a one-row aggregate that becomes a partition filter. NULL days
    match nothing, as in a join.
    """
    d = days.select(F.col(col)).where(F.col(col).isNotNull()).distinct()
    lo, hi = d.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return table.where(F.lit(False))
    return table.where(F.col(col).between(lo, hi)).join(d, col, "left_semi")


def posts_from_events(events: DataFrame, keep=()) -> DataFrame:
    """View ``posts``: one post per event; one in ten unscored, feedback in both spellings.

    ``keep`` passes further event columns through (e.g. ``ts`` for streaming).
    """
    eid = F.col("event_id")
    unscored = eid % 10 == 7
    sentiment = (F.when(unscored, F.lit(None).cast("string"))
                 .when(F.col("event_type").isin("purchase", "signup"), "positive")
                 .when(F.col("event_type").isin("view", "click"), "neutral")
                 .otherwise("negative"))
    confidence = F.when(unscored, F.lit(None).cast("double")).otherwise(
        F.lit(0.5) + (eid * 7919 % 5000).cast("double") / F.lit(10000.0))
    fb_digit = (eid % 3).cast("string")
    feedback = F.when(~unscored & (eid % 17 == 0),
                      F.when(eid % 2 == 0, fb_digit).otherwise(F.concat(fb_digit, F.lit(".0"))))
    return events.select(
        eid.cast("string").alias("id"),
        F.col("user_id").cast("string").alias("author_id"),
        F.col("ts").cast("date").alias("date"),
        sentiment.alias("sentiment"),
        confidence.alias("confidence"),
        feedback.alias("user_feedback"),
        *keep,
    )


def posts_text_from_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """View ``posts_text``: documents with a class from the optional label row.

    One label per document: the label side is grouped by ``doc_id`` (the same as a
    plain join while ``doc_id`` is unique in ``labels``). Being unique on the key,
    it lets Catalyst drop the join from every query that reads no label column, so
    text-only queries scan ``documents`` alone instead of shuffling all texts.
    """
    d = documents.alias("d")
    lab = (labels.groupBy("doc_id")
           .agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality")).alias("l"))
    sentiment = (F.when(F.col("l.doc_id").isNull(), F.lit(None).cast("string"))
                 .when(F.col("l.toxic") == 1, "negative")
                 .when(F.col("l.quality") == 1, "positive")
                 .otherwise("neutral"))
    return d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").cast("string").alias("id"),
        F.col("d.source").alias("author_id"),
        F.col("d.lang").alias("lang"),
        F.col("d.text").alias("text"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("d.doc_id") % 30).cast("int")).alias("date"),
        sentiment.alias("sentiment"),
    )


def predictions_from_events(events: DataFrame) -> DataFrame:
    """View ``predictions``: true class from the event type, every fourth one wrong."""
    label = (F.when(F.col("event_type").isin("purchase", "signup"), F.lit(2))
             .when(F.col("event_type").isin("view", "click"), F.lit(1))
             .otherwise(F.lit(0)))
    t = events.select(F.col("event_id"), label.alias("label"))
    return t.select(
        F.col("event_id").alias("id"), "label",
        F.when(F.col("event_id") % 4 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label")).alias("pred"),
    )


def training_runs_from_events(events: DataFrame) -> DataFrame:
    """View ``training_runs``: one ledger row per event (every event, so the ledger
    queries grow with the table)."""
    eid = F.col("event_id")
    return events.select(
        F.col("ts").alias("start_time"),
        F.timestamp_add("SECOND", (eid % 7200).cast("int"), F.col("ts")).alias("end_time"),
        (F.col("value") / F.lit(500.0)).alias("eval_loss"),
        F.when(eid % 400 == 0, F.lit(None).cast("double"))
         .otherwise((eid % 1000).cast("double") / F.lit(1000.0)).alias("eval_accuracy"),
        (F.col("value") / F.lit(10.0)).alias("eval_runtime"),
        ((eid % 37).cast("double") + F.lit(1.0)).alias("eval_samples_per_second"),
        F.lit(1.0).alias("epoch"),
    )


class Tables:
    """Lazy access to driver tables and fixture views for one scale-factor dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def posts(self) -> DataFrame:
        return posts_from_events(self.raw("events"))

    def posts_text(self) -> DataFrame:
        return posts_text_from_documents(self.raw("documents"), self.raw("labels"))

    def predictions(self) -> DataFrame:
        return predictions_from_events(self.raw("events"))

    def training_runs(self) -> DataFrame:
        return training_runs_from_events(self.raw("events"))

"""Target schemas and schema conformance (PRJ-03..07, DQ-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Silver post table: column list and order of the reference's post table.
POSTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("edit_history_tweet_ids", T.ArrayType(T.StringType())),
    T.StructField("author_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("user_feedback", T.StringType()),
    T.StructField("date", T.DateType()),
])

# Gold daily index (the surrogate id of the reference table is dropped; date is the key).
DAILY_REPUTATION = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("positive_count", T.LongType()),
    T.StructField("negative_count", T.LongType()),
    T.StructField("neutral_count", T.LongType()),
    T.StructField("reputation_index", T.DoubleType()),
])

# Run ledger, one row per training run.
TRAINING_RUNS = T.StructType([
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("epoch", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("eval_accuracy", T.DoubleType()),
    T.StructField("eval_f1", T.DoubleType()),
    T.StructField("eval_runtime", T.DoubleType()),
    T.StructField("eval_samples_per_second", T.DoubleType()),
    T.StructField("eval_steps_per_second", T.DoubleType()),
])

# Landed search response: meta + array of posts.
SEARCH_POST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("edit_history_tweet_ids", T.ArrayType(T.StringType())),
])
SEARCH_RESPONSE = T.StructType([
    T.StructField("meta", T.StructType([T.StructField("result_count", T.LongType())])),
    T.StructField("data", T.ArrayType(SEARCH_POST)),
])

# Training log rows: superset of step, evaluation and summary rows.
TRAINING_LOG = T.StructType([
    T.StructField(n, T.DoubleType()) for n in (
        "loss", "grad_norm", "learning_rate", "epoch",
        "eval_loss", "eval_accuracy", "eval_f1", "eval_runtime",
        "eval_samples_per_second", "eval_steps_per_second",
        "train_runtime", "train_samples_per_second", "train_steps_per_second",
        "train_loss", "total_flos")
] + [T.StructField("step", T.LongType())])


def conform(df: DataFrame, target: T.StructType = POSTS) -> DataFrame:
    """Add absent columns as typed NULLs, cast present ones, fix the order.

    The one-element edit history (PRJ-07) is derived from the id when the
    batch has none.
    """
    present = set(df.columns)
    cols = []
    for f in target.fields:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "edit_history_tweet_ids" and "id" in present:
            cols.append(F.array(F.col("id").cast("string")).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def schema_matches(df: DataFrame, target: T.StructType) -> bool:
    """DQ-06: same column names, order and types (nullability ignored)."""
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in target.fields]
    return got == want


def schema_report(df: DataFrame, target: T.StructType) -> DataFrame:
    """DQ-06: one row: columns found and expected, whether names, order and types agree, and the rows checked."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(len(df.columns)).alias("columns"), F.lit(len(target.fields)).alias("expected"), F.lit(schema_matches(df, target)).alias("matches"), "rows")

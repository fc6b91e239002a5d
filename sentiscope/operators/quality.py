"""Data quality report and reject split (DQ-01..05, CLN-03).

All checks come out of one two-level aggregate (per class, then over classes),
so the whole report is one pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import CLASS_NAMES, LABEL_SPELLINGS

# Thresholds of the reference's data tests.
MIN_PER_CLASS = 15
MAX_IMBALANCE = 10


def quality_report(scored: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: sizes, unmapped labels, class balance and a pass flag per check.

    ``scored`` holds the rows that should carry a label; ``label`` NULL means the
    label could not be mapped (D12).
    """
    per = scored.groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
    mapped = F.col(label_col).isNotNull()
    r = per.agg(
        F.sum("c").cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(~mapped, F.col("c"))), F.lit(0)).cast("long").alias("unmapped"),
        F.count_if(mapped).alias("classes"),
        F.min(F.when(mapped, F.col("c"))).alias("min_class"),
        F.max(F.when(mapped, F.col("c"))).alias("max_class"))
    ratio = F.col("max_class") / F.col("min_class")
    return r.select(
        "rows", "unmapped", "classes", "min_class", "max_class",
        F.round(ratio, 6).alias("imbalance_ratio"),
        (F.col("rows") > 0).alias("not_empty"),
        (F.col("unmapped") == 0).alias("all_mapped"),
        (F.col("classes") > 1).alias("multi_class"),
        F.coalesce(F.col("min_class") >= MIN_PER_CLASS, F.lit(False)).alias("min_class_ok"),
        F.coalesce(ratio < MAX_IMBALANCE, F.lit(False)).alias("balanced"))


def reject_reason(posts: DataFrame) -> F.Column:
    """CLN-03: why a post row cannot be used (NULL = accepted)."""
    sent_ok = F.col("sentiment").isNull() | F.col("sentiment").isin(*CLASS_NAMES)
    fb_ok = F.col("user_feedback").isNull() | F.col("user_feedback").isin(
        *[k for k in LABEL_SPELLINGS if k[0].isdigit()])
    return (F.when(F.col("id").isNull(), F.lit("missing_id"))
            .when(F.col("date").isNull(), F.lit("missing_date"))
            .when(~sent_ok, F.lit("unknown_sentiment"))
            .when(~fb_ok, F.lit("bad_feedback")))


def with_outcome(posts: DataFrame) -> DataFrame:
    """Rows tagged ``outcome`` (accepted / rejected) and ``reject_reason``."""
    reason = reject_reason(posts)
    return posts.select("*", reason.alias("reject_reason"),
                        F.when(reason.isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
                        .alias("outcome"))


def write_outcomes(posts: DataFrame, path: str) -> None:
    """CLN-03 as one job: a single scan writes accepted and rejected rows (with their
    reason) into the ``outcome=accepted`` / ``outcome=rejected`` folders of one
    table, instead of two filtered writes that would each read the input again."""
    with_outcome(posts).write.mode("overwrite").partitionBy("outcome").parquet(path)


def rejects_by_reason(posts: DataFrame) -> DataFrame:
    reason = F.coalesce(reject_reason(posts), F.lit("accepted"))
    return posts.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))

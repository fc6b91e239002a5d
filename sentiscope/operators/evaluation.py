"""Evaluation of a predictions frame ``(id, label, pred)`` (AGG-14..17, FLT-09, TOP-05, WIN-01).

Every metric is computed from the confusion counts, a pre-aggregate of at most
k*k rows per task: the fact data is read once and only tiny partial rows are
shuffled, whatever the class skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.labels import class_name


def confusion_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(pred: DataFrame) -> DataFrame:
    """AGG-14."""
    return pred.agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))


def per_class_f1(pred: DataFrame) -> DataFrame:
    """F1 of every class seen in truth or prediction (SET-02): 2tp / (support + predicted)."""
    cm = confusion_counts(pred)
    as_true = cm.select(F.col("label").alias("cls"),
                        F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                        F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"))
    as_pred = cm.select(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"),
                        F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))
    per = as_true.unionByName(as_pred).groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    denom = F.col("support") + F.col("predicted")
    return per.withColumn("f1", F.when(denom > 0, F.lit(2.0) * F.col("tp") / denom).otherwise(F.lit(0.0)))


def macro_f1(pred: DataFrame) -> DataFrame:
    """AGG-15: unweighted mean of the per-class F1."""
    return per_class_f1(pred).agg(F.round(F.avg("f1"), 6).alias("macro_f1"),
                                  F.count(F.lit(1)).alias("classes"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """AGG-16: counts and share within the true class (window over <= k*k rows)."""
    cm = confusion_counts(pred)
    w = Window.partitionBy("label")
    return cm.select(
        "label", "pred",
        class_name(F.col("label")).alias("label_name"),
        class_name(F.col("pred")).alias("pred_name"),
        "n",
        F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"))


def misclassified(pred: DataFrame, k: int | None = None) -> DataFrame:
    """FLT-09: all wrong predictions; with ``k`` the first by id (TOP-05)."""
    wrong = pred.where(F.col("label") != F.col("pred"))
    return ((wrong if k is None else wrong.orderBy("id").limit(k))
            .select("id", "label", "pred",
                    class_name(F.col("label")).alias("label_name"),
                    class_name(F.col("pred")).alias("pred_name")))


def misclassification_rate(pred: DataFrame) -> DataFrame:
    """AGG-17 + SCL-17: wrong, total, percent with two decimals."""
    wrong = F.count_if(F.col("label") != F.col("pred"))
    total = F.count(F.lit(1))
    return pred.agg(wrong.alias("wrong"), total.alias("total"),
                    F.round(F.lit(100.0) * wrong / total, 2).alias("wrong_percent"))

"""Multinomial naive Bayes over word counts (ML-07..11, AGG-18, SNK-07): a classifier in closed form.

Fitting is two aggregates, words by class and rows by class, kept as a model table. Several smoothing
settings are scored in one pass: the rows' word counts meet the word table in one join,
which sums the evidence of each setting side by side. The best setting on the validation rows is
chosen, evaluated on the test rows (loss, accuracy, macro-F1 from the classifier's own
probabilities) and stored with the counts, so that a reloaded model predicts alike. Every step is a join or an aggregate,
so every number can be checked by SQL. Ties go to the smaller class id and the earlier setting; an
empty or null text takes the most frequent class.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import words
from ..session import scratch_path
from ..sources import segments

SETTINGS = (0.05, 0.2, 1.0)
EPS = 1e-15
MODEL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("token", T.StringType()), T.StructField("label", T.IntegerType()),
                      T.StructField("n", T.LongType()), T.StructField("value", T.DoubleType())])


def fit(train: DataFrame) -> DataFrame:
    """ML-07: the model table of the rows (``text``, ``label``), written once: a row for each word and class, and for each class."""
    spark = train.sparkSession
    token = F.explode(words(F.col("text")))
    none = F.lit(None)
    seen = train.select("label", token.alias("token")).groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    rows = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    label = F.col("label").cast("int").alias("label")
    model = seen.select(F.lit("word").alias("kind"), "token", label, "n", none.cast("double").alias("value")).unionByName(
        rows.select(F.lit("class").alias("kind"), none.cast("string").alias("token"), label, "n", none.cast("double").alias("value")))
    path = scratch_path(spark, "word-counts")
    model.write.parquet(path)
    return spark.read.parquet(path)


def predict(model: DataFrame, rows: DataFrame, settings: tuple[float, ...] = (1.0,)) -> DataFrame:
    """ML-11: ``id``, ``label``, ``setting`` (its number), ``pred`` and ``p_true`` (the label's probability) of ``rows`` (id, text,
    label), a row for each setting."""
    seen = model.where("kind = 'word'")
    # numbers that are one for each class (label ids, fewer than ten)
    tokens = {r.label: r.t for r in seen.groupBy("label").agg(F.sum("n").alias("t")).collect()}
    v = seen.agg(F.count_distinct("token")).first()[0]
    classes = sorted((r.label, r.n) for r in model.where("kind = 'class'").collect())
    if not classes:
        return rows.select("id", "label", F.lit(0).alias("setting"), F.lit(None).cast("int").alias("pred"), F.lit(None).cast("double").alias("p_true"))
    each_setting = range(len(settings))
    table = F.array(*[F.struct(F.lit(c).alias("pred"), F.lit(math.log(n)).alias("prior"), F.array(
        *[F.lit(math.log(a) - math.log((tokens.get(c) or 0) + a * v) if v else 0.0) for a in settings]).alias("each")) for c, n in classes])
    counts = rows.select("id", F.explode(words(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("m"))
    known = counts.join(seen.select("token", F.col("label").alias("pred"), "n"), "token").groupBy("id", "pred").agg(
        *[F.sum(F.col("m") * (F.ln(F.col("n") + a) - F.lit(math.log(a)))).alias(f"e{k}") for k, a in enumerate(settings)])
    sized = rows.select("id", "label", F.size(words(F.coalesce("text", F.lit("")))).alias("size"), F.inline(table))
    score = lambda k: F.col("prior") + F.coalesce(f"e{k}", F.lit(0.0)) + F.col("size") * F.get("each", k)
    scored = sized.join(known, ["id", "pred"], "left").select("id", "label", "pred", F.array(*[score(k) for k in each_setting]).alias("s"))
    # each row beside its few classes
    together = scored.groupBy("id", "label").agg(F.collect_list(F.struct("s", "pred")).alias("c"))
    at = lambda k: F.transform("c", lambda x: F.struct(x["s"][k].alias("s"), (-x["pred"]).alias("p")))

    def answer(k):
        best = F.array_max(at(k))
        power = lambda keep: F.aggregate(F.filter(at(k), keep), F.lit(0.0), lambda a, x: a + F.exp(x["s"] - best["s"]))
        own = power(lambda x: -x["p"] == F.col("label")) / power(lambda x: F.lit(True))
        return F.struct(F.lit(k).alias("setting"), (-best["p"]).cast("int").alias("pred"), own.alias("p_true"))

    return together.select("id", "label", F.inline(F.array(*[answer(k) for k in each_setting])))


def metrics(pred: DataFrame) -> DataFrame:
    """ML-09, AGG-18: ``eval_loss``, ``eval_accuracy``, ``eval_f1`` (macro) and ``rows`` of each setting."""
    p = F.greatest(F.least(F.coalesce("p_true", F.lit(0.0)), F.lit(1 - EPS)), F.lit(EPS))
    cells = pred.groupBy("setting", "label", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum(-F.ln(p)).alias("loss"))
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    sides = cells.select("setting", F.col("label").alias("cls"), hit.alias("tp"), "n").unionByName(
        cells.select("setting", F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), "n"))
    f1 = (sides.groupBy("setting", "cls").agg((2.0 * F.sum("tp") / F.sum("n")).alias("f1"))
          .groupBy("setting").agg(F.round(F.avg("f1"), 6).alias("eval_f1")))
    whole = cells.groupBy("setting").agg(F.round(F.sum("loss") / F.sum("n"), 6).alias("eval_loss"),
                                         F.round(F.sum(hit) / F.sum("n"), 6).alias("eval_accuracy"), F.sum("n").alias("rows"))
    return whole.join(f1, "setting").select("setting", "eval_loss", "eval_accuracy", "eval_f1", "rows")


def train_evaluate(split: DataFrame, settings: tuple[float, ...] = SETTINGS) -> tuple[DataFrame, dict]:
    """ML-07..09 on (id, text, label, split): the model table with the chosen setting, and the numbers of its test."""
    model = fit(split.where("split = 'train'"))
    tried = {r.setting: r for r in metrics(predict(model, split.where("split = 'validation'"), settings)).collect()}  # one row a setting
    best = max(tried, key=lambda k: (tried[k].eval_f1, -k), default=0)
    chosen = settings[best]
    done = metrics(predict(model, split.where("split = 'test'"), (chosen,))).first()
    result = {"smoothing": chosen, "val_f1": tried[best].eval_f1 if tried else None, **{k: done[k] if done else None for k in ("eval_loss", "eval_accuracy", "eval_f1")},
              "test_rows": done["rows"] if done else 0}
    kept = model.unionByName(model.sparkSession.createDataFrame([("smoothing", None, None, None, chosen)], MODEL))
    return kept, result


def save_model(model: DataFrame, root: str) -> None:
    """SNK-07: the model becomes the served version of a model table; readers see the old or the new one."""
    segments.replace(model, root, MODEL)


def load_model(spark: SparkSession, root: str) -> tuple[DataFrame, float]:
    model = segments.read(spark, root, MODEL)
    return model, model.where("kind = 'smoothing'").first().value


def predict_split(split: DataFrame, target: str = "test", smoothing: float = 1.0) -> DataFrame:
    """Fit on the ``train`` rows of ``split`` (id, text, label, split), predict the ``target``
    rows: (id, label, pred)."""
    return predict(fit(split.where("split = 'train'")), split.where(F.col("split") == target), (smoothing,)).select("id", "label", "pred")

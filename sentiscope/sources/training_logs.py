"""Training logs (SRC-06, SNK-08, SCL-19).

A log is a JSON array of rows of three kinds (step, evaluation, summary); the
run time exists only in the path (``train_logYYYYMMDD_HHMMSS.json``, or the
``run=YYYYMMDD_HHMMSS`` directory that Spark's writer produces). The reader
uses the superset schema and ``_metadata.file_path``; no driver-side listing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import TRAINING_LOG

RUN_IN_PATH = r"(?:train_log|run=)(\d{8}_\d{6})"


def row_kind() -> F.Column:
    return (F.when(F.col("train_runtime").isNotNull(), F.lit("summary"))
            .when(F.col("eval_loss").isNotNull() | F.col("eval_accuracy").isNotNull(), F.lit("eval"))
            .otherwise(F.lit("step")))


def read_training_logs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of every log under ``path``; the run comes from a ``run`` field when the
    writer stored one, else from the file or directory name."""
    schema = T.StructType(TRAINING_LOG.fields + [T.StructField("run", T.StringType())])
    df = (spark.read.schema(schema).option("multiLine", multi_line)
          .option("recursiveFileLookup", True).json(path))
    run = F.coalesce(F.col("run"), F.regexp_extract(F.col("_metadata.file_path"), RUN_IN_PATH, 1))
    return df.select(
        F.to_timestamp(run, "yyyyMMdd_HHmmss").cast("timestamp_ntz").alias("run_time"),
        row_kind().alias("kind"), *TRAINING_LOG.fieldNames())


def write_run_log(spark: SparkSession, rows: list[dict], path: str, start) -> str:
    """SNK-08: the log of one run as a JSON array, the run's time in the name alone."""
    out = f"{path}/train_log{start:%Y%m%d_%H%M%S}.json"
    kept = [{k: v for k, v in r.items() if v is not None} for r in rows]
    spark.createDataFrame([(json.dumps(kept, indent=1),)], "value string").coalesce(1).write.mode("overwrite").text(out)
    return out


def log_rows_from_runs(runs: DataFrame) -> DataFrame:
    """Evaluation and summary rows of each ledger run, tagged with its run directory."""
    secs = (F.unix_timestamp(F.col("end_time").cast("timestamp"))
            - F.unix_timestamp(F.col("start_time").cast("timestamp"))).cast("double")
    null = F.lit(None).cast("double")
    base = {n: null for n in TRAINING_LOG.fieldNames()}
    ev = dict(base, epoch=F.col("epoch"), eval_loss=F.col("eval_loss"),
              eval_accuracy=F.col("eval_accuracy"), eval_runtime=F.col("eval_runtime"),
              eval_samples_per_second=F.col("eval_samples_per_second"), step=F.lit(1).cast("long"))
    sm = dict(base, epoch=F.col("epoch"), train_runtime=secs, step=F.lit(1).cast("long"))
    names = TRAINING_LOG.fieldNames()
    rows = F.array(F.struct(*[ev[n].alias(n) for n in names]), F.struct(*[sm[n].alias(n) for n in names]))
    return runs.select(F.date_format("start_time", "yyyyMMdd_HHmmss").alias("run"),
                       F.inline(rows))


def write_training_logs(rows: DataFrame, path: str) -> None:
    """SNK-08: JSON rows of many runs in one dataset.

    One file per run (the reference's layout) turns thousands of runs into
    thousands of tiny files; here the run id is a field of every row and files
    are grouped by run day. A ``rebalance`` on the day clusters each day's rows
    into few tasks (few files per folder), and AQE splits any partition above the
    advisory size, so a busy day, or one run with very many rows, is written by
    several tasks.
    """
    (rows.withColumn("run_day", F.substring("run", 1, 8))
     .hint("rebalance", "run_day")
     .write.mode("overwrite").partitionBy("run_day").json(path))

"""The corpus pipeline: documents in, a mixed training corpus out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet under the shared scratch folder and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``, whatever else they are called; the last adds ``copy``.

Odd rows: a null or empty text is a document without words. It is judged by the classifier like any other; where it stays, it is
no near copy of another, loses no words, holds no benchmark item and is taken 0 words. Null ids, languages
and sources and repeated rows are rows like others; of rows with equal id and text the near-copy stage keeps one. An empty table
goes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentiscope.llm import decontam, fm_quality, mixing, ngram_join, substring_dedup
from sentiscope.llm.common import table
from sentiscope.session import checkpoint_root
from sentiscope.sources import segments

#: Words that a benchmark item has at least to remove the documents that hold it; short items remove many
#: (``decontam.documents_per_item`` counts them).
MIN_ITEM_WORDS = 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    model = fm_quality.train(docs, fm_quality.learnable(table(spark, sf_dir, "labels")))
    return fm_quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id."""
    return ngram_join.drop_near_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows seen earlier; a document that loses
    all its words goes, ``n_chars`` follows the text."""
    out = substring_dedup.remove_repeats(docs, layout=True)
    out = out.where("n_removed = 0 or n_removed < n_words")
    changed = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("kept"), "n_chars": changed}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_words=MIN_ITEM_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_join", near_copies),
    ("substring_dedup", substrings),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: No SQL: stages fit a model and hash texts in ways that DuckDB cannot repeat; the tests
#: run each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None, keep: bool = True) -> DataFrame:
    """The mixed corpus: the rows of the last stage.

    With a ``run_id`` a run whose driver was lost goes on after the last stage it had finished. With ``keep`` false a stage's
    table is deleted once the next one is written.
    """
    root = f"{checkpoint_root(spark)}/pipeline-{run_id or uuid.uuid4().hex[:12]}"
    paths = [f"{root}/{name}" for name, _ in STAGES]
    finished = max((n for n, p in enumerate(paths) if segments.exists(spark, f"{p}/_SUCCESS")), default=-1)
    docs = spark.read.parquet(paths[finished]) if finished >= 0 else table(spark, sf_dir, "documents")
    for n in range(finished + 1, len(STAGES)):
        STAGES[n][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[n])
        docs = spark.read.parquet(paths[n])
        if n and not keep:
            segments.delete(spark, paths[n - 1])
    return docs

"""Update by key (JON-01/02, WIN-03, FLT-10).

The reference issues one ``UPDATE ... WHERE id = ?`` per row. Here updates are
first reduced to the last write per key (``max_by`` over a sequence number, a
hash aggregate with map-side combine, so a key updated millions of times is
still one partial row per task), then applied with one left join and
``coalesce``. The join is an equi-join on the key: AQE broadcasts the update
side when its measured size is small and otherwise runs a sort-merge join,
splitting skewed key partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import canonical_feedback


def last_write_per_key(updates: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """WIN-03: one row per key with the values of its highest ``seq`` (of equal ones, the
    largest values)."""
    latest = updates.groupBy(key).agg(F.max(F.struct(seq, *[c for c in cols if c != seq])).alias("_u"))
    return latest.select(key, *[F.col(f"_u.{c}").alias(c) for c in cols])


def apply_updates(base: DataFrame, updates: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """Left join of the reduced updates; updated columns take the new value when present."""
    u = last_write_per_key(updates, key, seq, cols)
    u = u.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = base.join(u, key, "left")
    out = []
    for c in base.columns:
        out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c))
    return joined.select(*out)


def apply_scores(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """JON-01: write model ``sentiment``/``confidence`` back by id (scores: id, seq, sentiment, confidence)."""
    return apply_updates(posts, scores, "id", "seq", ["sentiment", "confidence"])


def split_feedback(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-10: valid answers (canonical text) and rejected ones."""
    canon = canonical_feedback(F.col("answer"))
    tagged = answers.withColumn("user_feedback", canon)
    return (tagged.where(F.col("user_feedback").isNotNull()).drop("answer"),
            tagged.where(F.col("user_feedback").isNull()).drop("user_feedback"))


def apply_feedback(posts: DataFrame, answers: DataFrame) -> DataFrame:
    """JON-02: reviewer answers (id, seq, answer) -> ``user_feedback``; invalid answers never land."""
    valid, _ = split_feedback(answers)
    return apply_updates(posts, valid, "id", "seq", ["user_feedback"])

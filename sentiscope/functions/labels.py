"""Class vocabulary: canonical ids, display names, argmax (SCL-05/06/09/20)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Class names by id, and the nine accepted spellings of a label.
CLASS_NAMES = ("negative", "neutral", "positive")
LABEL_SPELLINGS = {
    "negative": 0, "neutral": 1, "positive": 2,
    "0": 0, "1": 1, "2": 2,
    "0.0": 0, "1.0": 1, "2.0": 2,
}
# Spellings a reviewer may type (FLT-10).
FEEDBACK_ANSWERS = ("0", "1", "2")


def _label_map() -> Column:
    return F.create_map(*[x for k, v in LABEL_SPELLINGS.items() for x in (F.lit(k), F.lit(v))])


def canonical_label(text: Column) -> Column:
    """SCL-06: id 0/1/2 from any accepted spelling; NULL when unknown (D12)."""
    return F.try_element_at(_label_map(), text.cast("string"))


def label_source(sentiment: Column, feedback: Column, source: str = "feedback_first") -> Column:
    """SCL-05 / D11: the human label wins when present, else the model label."""
    if source == "model":
        return sentiment
    return F.coalesce(feedback, sentiment)


def class_name(label_id: Column) -> Column:
    """SCL-20: id -> display name."""
    names = F.array(*[F.lit(n) for n in CLASS_NAMES])
    return F.when(label_id.between(0, len(CLASS_NAMES) - 1),
                  F.element_at(names, (label_id + 1).cast("int")))


def argmax(scores: Column) -> Column:
    """SCL-09: 0-based index of the largest score, first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def canonical_feedback(answer: Column) -> Column:
    """D10: accepted answers stored as the integer text '0'/'1'/'2'."""
    return F.when(F.trim(answer).isin(*FEEDBACK_ANSWERS), F.trim(answer))

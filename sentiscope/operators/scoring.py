"""Sentiment scoring of posts (UDF-01, ML-05, ML-06, JON-04).

Two back ends share one output shape ``struct<label string, score double>``
(lower-case label, score of the top class in [0, 1]):

* ``lexicon_scores``: built-in array functions only, fully JVM-side; the
  deterministic scorer used to value-check the score -> write back -> index path.
* ``softmax_scores``: the default model, the same way: a softmax over lexicon counts.
* ``score_udf``: an iterator ``pandas_udf`` over Arrow batches; the model is
  built once per Python worker (lazy single load) and applied to whole batches.
  Any callable ``texts -> (labels, scores)`` can be plugged in through
  ``model_factory``.

The score is a column of the same row, so predictions never need to be matched
back to rows by position (JON-04).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import CLASS_NAMES
from ..functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, count_words

SCORE_TYPE = "struct<label:string,score:double>"
NEUTRAL_BIAS = 0.5


def lexicon_scores(posts: DataFrame, text_col: str = "text") -> DataFrame:
    """ML-06: positive/negative word counts -> label and confidence."""
    p = count_words(F.col(text_col), POSITIVE_WORDS)
    g = count_words(F.col(text_col), NEGATIVE_WORDS)
    label = F.when(p > g, "positive").when(g > p, "negative").otherwise("neutral")
    conf = (F.lit(1.0) + F.abs(p - g).cast("double")) / (F.lit(2.0) + (p + g).cast("double"))
    return posts.select("id", p.alias("n_pos"), g.alias("n_neg"), label.alias("sentiment"),
                        F.round(conf, 6).alias("confidence"))


def softmax_scores(text: Column) -> Column:
    """Default model: logits (negative, neutral, positive) = (#neg words, bias, #pos words);
    the first of equal classes wins."""
    g, p = (count_words(text, v).cast("double") for v in (NEGATIVE_WORDS, POSITIVE_WORDS))
    logits = (g, F.lit(NEUTRAL_BIAS), p)
    top = F.greatest(*logits)
    label = F.when(g == top, CLASS_NAMES[0]).when(F.lit(NEUTRAL_BIAS) == top, CLASS_NAMES[1]).otherwise(CLASS_NAMES[2])
    total = sum((F.exp(z - top) for z in logits[1:]), F.exp(logits[0] - top))
    return F.struct(label.alias("label"), (F.lit(1.0) / total).alias("score"))


class LexiconSoftmax:
    """The default model as a plug-in: an example of a callable for ``score_udf``."""

    _split = re.compile(r"[^a-z0-9]+")

    def __init__(self, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS, bias=NEUTRAL_BIAS):
        self.pos, self.neg, self.bias = frozenset(positive), frozenset(negative), bias

    def __call__(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        toks = texts.fillna("").str.lower().map(self._split.split)
        p = toks.map(lambda ts: sum(t in self.pos for t in ts)).to_numpy(dtype=np.float64)
        g = toks.map(lambda ts: sum(t in self.neg for t in ts)).to_numpy(dtype=np.float64)
        z = np.stack([g, np.full_like(p, self.bias), p], axis=1)
        z = z - z.max(axis=1, keepdims=True)
        e = np.exp(z)
        prob = e / e.sum(axis=1, keepdims=True)
        idx = prob.argmax(axis=1)
        return np.asarray(CLASS_NAMES, dtype=object)[idx], prob[np.arange(len(idx)), idx]


def score_udf(model_factory: Callable[[], Callable] = LexiconSoftmax):
    """UDF-01: texts -> struct(label, score), one model per worker, Arrow batches."""

    @F.pandas_udf(SCORE_TYPE)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for texts in batches:
            labels, scores = model(texts)
            yield pd.DataFrame({"label": labels, "score": scores})

    return _score


def score_posts(posts: DataFrame, model_factory: Callable[[], Callable] | None = None,
                text_col: str = "text") -> DataFrame:
    """ML-05: score rows (e.g. the pending ones); label and confidence of the top class (SCL-10)."""
    s = softmax_scores(F.col(text_col)) if model_factory is None else score_udf(model_factory)(F.col(text_col))
    return (posts.select("id", s.alias("_s"))
            .select("id", F.col("_s.label").alias("sentiment"),
                    F.round(F.col("_s.score"), 6).alias("confidence")))

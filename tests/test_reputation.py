"""Daily index: golden arithmetic and the reference-semantics decisions D1-D4, D18."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sentiscope.operators import reputation as rep
from sentiscope.schemas import POSTS, conform
from sentiscope.sources import sinks

D = dt.date


def posts(spark, rows):
    df = spark.createDataFrame(rows, "id string, date date, sentiment string")
    return conform(df, POSTS)


def index_by_day(df):
    return {r["date"]: r["reputation_index"] for r in df.collect()}


def test_golden_one_of_each(spark):
    p = posts(spark, [("1", D(2024, 1, 1), "positive"), ("2", D(2024, 1, 1), "neutral"),
                      ("3", D(2024, 1, 1), "negative")])
    r = rep.daily_reputation(p).collect()[0]
    assert (r.positive_count, r.neutral_count, r.negative_count) == (1, 1, 1)
    assert r.reputation_index == 0.0  # (2 + 1 - 3) / 3


def test_golden_extremes_and_unscored(spark):
    p = posts(spark, [("1", D(2024, 1, 1), "negative"), ("2", D(2024, 1, 1), "negative"),
                      ("3", D(2024, 1, 2), "positive"),
                      ("4", D(2024, 1, 3), None), ("5", D(2024, 1, 3), "unknown")])
    got = index_by_day(rep.daily_reputation(p))
    assert got == {D(2024, 1, 1): -3.0, D(2024, 1, 2): 2.0, D(2024, 1, 3): 0.0}  # D3


def test_negative_tie_rounds_half_up(spark):
    # (2*1 + 1*0 - 3*7) / 8 = -2.375 -> -2.38 (half away from zero on the decimal value)
    rows = [("p", D(2024, 1, 1), "positive")] + [(f"n{i}", D(2024, 1, 1), "negative") for i in range(7)]
    assert index_by_day(rep.daily_reputation(posts(spark, rows))) == {D(2024, 1, 1): -2.38}


def test_every_day_emitted_and_closed_variant_drops_latest(spark):
    p = posts(spark, [("1", D(2024, 1, 1), "positive"), ("2", D(2024, 1, 2), "negative"),
                      ("3", D(2024, 1, 3), "neutral")])
    assert sorted(index_by_day(rep.daily_reputation(p))) == [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)]  # D1
    assert sorted(index_by_day(rep.daily_reputation_closed(p))) == [D(2024, 1, 1), D(2024, 1, 2)]


def test_null_date_never_reaches_a_day(spark):
    p = posts(spark, [("1", None, "negative"), ("2", D(2024, 1, 1), "positive")])
    got = rep.daily_reputation(p).collect()
    assert len(got) == 1 and got[0].negative_count == 0  # D2


def test_pivot_equals_conditional_counts(spark):
    p = posts(spark, [("1", D(2024, 1, 1), "positive"), ("2", D(2024, 1, 1), "positive"),
                      ("3", D(2024, 1, 2), "negative"), ("4", D(2024, 1, 2), None)])
    a = {tuple(r) for r in rep.class_counts_pivot(p).collect()}
    b = {tuple(r) for r in rep.daily_reputation(p).drop("reputation_index").collect()}
    assert a == b


def test_weights_text_matches_literal_weights(spark):
    p = posts(spark, [("1", D(2024, 1, 1), "positive"), ("2", D(2024, 1, 1), "negative"),
                      ("3", D(2024, 1, 1), "negative")])
    a = rep.daily_reputation_weighted_by_text(p, " 2, 1 ,3").collect()[0]
    assert (a.w_positive, a.w_neutral, a.w_negative) == (2.0, 1.0, 3.0)
    assert a.reputation_index == rep.daily_reputation(p).collect()[0].reputation_index == -1.33


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_within_bounds(spark, seed):
    import random
    rnd = random.Random(seed)
    rows = [(str(i), D(2024, 1, 1 + rnd.randrange(5)), rnd.choice(["positive", "neutral", "negative", None]))
            for i in range(300)]
    for r in rep.daily_reputation(posts(spark, rows)).collect():
        assert -3.0 <= r.reputation_index <= 2.0


def test_publish_skips_empty_input_and_replaces_serving(spark, scratch):
    root = f"{scratch}/rep"
    p = posts(spark, [("1", D(2024, 1, 1), "positive")])
    assert sinks.publish(rep.daily_reputation(p), root) is not None
    empty = rep.daily_reputation(p.where(F.lit(False)))
    assert sinks.publish(empty, root) is None  # D18: the served table stays
    assert sinks.serving(spark, root).count() == 1
    p2 = posts(spark, [("1", D(2024, 1, 2), "negative"), ("2", D(2024, 1, 3), "neutral")])
    sinks.publish(rep.daily_reputation(p2), root)
    assert sinks.serving(spark, root).count() == 2


def test_a_publish_that_dies_leaves_the_old_version(spark, scratch, monkeypatch):
    import datetime as dt
    import pytest
    from sentiscope.sources import segments, sinks
    root = f"{scratch}/pub"
    one = spark.createDataFrame([(dt.date(2024, 1, 1), "positive")], "date date, sentiment string")
    two = one.unionByName(spark.createDataFrame([(dt.date(2024, 1, 2), "negative")], one.schema))
    sinks.publish(rep.daily_reputation(one), root)
    real = segments._commit

    def dies(*a):
        raise RuntimeError("driver lost before the manifest is written")

    monkeypatch.setattr(segments, "_commit", dies)
    with pytest.raises(RuntimeError):
        sinks.publish(rep.daily_reputation(two), root)
    assert sinks.serving(spark, root).count() == 1  # all rows are written, and none is seen
    monkeypatch.setattr(segments, "_commit", real)
    sinks.publish(rep.daily_reputation(two), root)
    assert sinks.serving(spark, root).count() == 2
    assert sinks.publish(rep.daily_reputation(one.limit(0)), root) is None
    assert sinks.serving(spark, root).count() == 2


def test_old_versions_go_after_some_publishes(spark, scratch):
    import os
    from sentiscope.sources import segments, sinks
    p = posts(spark, [("1", D(2024, 1, 1), "positive")])
    for _ in range(8):
        sinks.publish(rep.daily_reputation(p), f"{scratch}/rep")
    assert len([n for n in os.listdir(f"{scratch}/rep") if n.startswith("segment=")]) <= segments.KEEP + 1
    assert len(os.listdir(f"{scratch}/rep/_manifest")) <= segments.KEEP + 2

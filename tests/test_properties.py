"""Generated-input properties: each operator against a plain-Python model of the
same rule on random small frames (NULL days, unknown labels, repeated and hot keys)."""

import datetime as dt
import math
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings, strategies as st

from sentiscope.operators import ingest as ing
from sentiscope.operators import labelling as lab
from sentiscope.operators import reputation as rep
from sentiscope.operators import updates as upd

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

DAYS = st.one_of(st.none(), st.integers(0, 4).map(lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)))
LABELS = st.sampled_from([None, "positive", "neutral", "negative", "mixed"])
IDS = st.integers(0, 30).map(str)


def _index(p, n, g):
    """Unrounded index with weights 2, 1, 3; the operator rounds it to two decimals."""
    total = p + n + g
    return 0.0 if total == 0 else (2.0 * p + 1.0 * n - 3.0 * g) / total


@SETTINGS
@given(rows=st.lists(st.tuples(DAYS, LABELS), min_size=1, max_size=40))
def test_daily_index_matches_model(spark, rows):
    df = spark.createDataFrame(rows, "date date, sentiment string")
    got = {r.date: r for r in rep.daily_reputation(df).collect()}
    per_day = defaultdict(Counter)
    for d, s in rows:
        if d is not None:
            per_day[d][s] += 1
    assert set(got) == set(per_day)
    for d, c in per_day.items():
        r = got[d]
        assert (r.positive_count, r.neutral_count, r.negative_count) == (
            c["positive"], c["neutral"], c["negative"])
        assert -3.0 <= r.reputation_index <= 2.0
        assert math.isclose(r.reputation_index, _index(c["positive"], c["neutral"], c["negative"]),
                            abs_tol=0.005 + 1e-9)


@SETTINGS
@given(base_ids=st.sets(IDS, min_size=1, max_size=15),
       updates=st.lists(st.tuples(IDS, st.sampled_from(["positive", "neutral", "negative"])),
                        max_size=30))
def test_updates_last_write_wins_and_replay_is_idempotent(spark, base_ids, updates):
    base = spark.createDataFrame([(i, None, None) for i in sorted(base_ids)],
                                 "id string, sentiment string, confidence double")
    ups = spark.createDataFrame([(i, seq, s, 0.5 + seq / 1000.0) for seq, (i, s) in enumerate(updates)],
                                "id string, seq long, sentiment string, confidence double")
    want = {i: (None, None) for i in base_ids}
    for seq, (i, s) in enumerate(updates):
        if i in want:
            want[i] = (s, 0.5 + seq / 1000.0)
    once = upd.apply_scores(base, ups)
    assert {r.id: (r.sentiment, r.confidence) for r in once.collect()} == want
    twice = upd.apply_scores(once, ups)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


@SETTINGS
@given(ids=st.lists(IDS, min_size=1, max_size=60), hot=st.integers(0, 40))
def test_exact_split_sizes_with_repeated_keys(spark, ids, hot):
    rows = [(i, "positive") for i in ids] + [("hot", "negative")] * hot
    df = spark.createDataFrame(rows, "id string, label string")
    out = lab.train_val_test_split(df, "id", 42, 0.2, 0.1)
    sizes = Counter(r.split for r in out.collect())
    n = len(rows)
    t = math.ceil(0.2 * n)
    v = math.ceil(0.1 * (n - t))
    assert sizes["test"] == t and sizes["validation"] == v and sizes["train"] == n - t - v
    assert sum(sizes.values()) == n


@SETTINGS
@given(batch=st.lists(IDS, max_size=40), known=st.lists(IDS, max_size=40))
def test_new_only_is_set_difference_once(spark, batch, known):
    b = spark.createDataFrame([(i, k) for k, i in enumerate(batch)], "id string, k long")
    kn = spark.createDataFrame([(i,) for i in known], "id string")
    got = [r.id for r in ing.new_only(b, kn).collect()]
    assert sorted(got) == sorted(set(batch) - set(known))


@SETTINGS
@given(rows=st.lists(st.tuples(IDS, st.integers(0, 2)), min_size=1, max_size=60),
       hot=st.integers(0, 60))
def test_stratified_split_is_exact_inside_every_class(spark, rows, hot):
    rows = rows + [("hot", 1)] * hot  # one key and one class can hold most of the rows
    df = spark.createDataFrame(rows, "id string, label int")
    out = lab.train_val_test_split(df, "id", 42, 0.2, 0.1, stratify_by="label")
    got = Counter((r.label, r.split) for r in out.collect())
    for c, n in Counter(lbl for _, lbl in rows).items():
        t = math.ceil(0.2 * n)
        v = math.ceil(0.1 * (n - t))
        assert (got[(c, "test")], got[(c, "validation")], got[(c, "train")]) == (t, v, n - t - v)

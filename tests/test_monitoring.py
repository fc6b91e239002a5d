"""Panel helpers: inclusive ranges, relative ranges, threshold bands, ordered top-k."""

import datetime as dt

from pyspark.sql import functions as F

from sentiscope.functions import bands
from sentiscope.operators import monitoring as mon

D = dt.date


def test_band_ladders_at_the_boundaries(spark):
    vals = [(-0.5,), (0.0,), (0.49,), (0.5,), (0.7,), (0.8,), (0.9,), (1.0,), (None,)]
    df = spark.createDataFrame(vals, "v double")
    got = [r[0] for r in df.select(bands.band(F.col("v"), bands.ACCURACY_STEPS)).collect()]
    assert got == ["red", "green", "green", "red", "orange", "yellow", "green", "green", None]
    counts = spark.createDataFrame([(0,), (99,), (100,), (200,), (500,)], "c long")
    got = [r[0] for r in counts.select(bands.band(F.col("c"), bands.POST_COUNT_STEPS)).collect()]
    assert got == ["red", "red", "blue", "green", "#6ED0E0"]


def test_ranges_are_inclusive_and_relative_range_uses_latest_day(spark):
    df = spark.createDataFrame([(D(2024, 1, d),) for d in range(1, 11)], "date date")
    assert mon.in_date_range(df, "2024-01-03", "2024-01-05").count() == 3
    assert [r.date.day for r in mon.last_n_days(df, 2).orderBy("date").collect()] == [8, 9, 10]
    assert mon.last_n_days(df, 2, anchor="2024-01-04").count() == 3


def test_reputation_bands_percent_of_range(spark):
    rows = [("1", D(2024, 1, 1), "positive", 0.9), ("2", D(2024, 1, 2), "negative", 0.5)]
    posts = spark.createDataFrame(rows, "id string, date date, sentiment string, confidence double")
    r = mon.reputation_bands(posts, "2024-01-01", "2024-01-02").first()
    # daily indexes 2 and -3 -> mean -0.5 -> (-0.5 + 3) / 5 = 50 % ; confidence 0.7 -> 70 %
    assert (r.mean_reputation_index, r.index_percent, r.index_band) == (-0.5, 50.0, "orange")
    assert (r.mean_confidence, r.confidence_percent, r.confidence_band) == (0.7, 70.0, "orange")


def test_latest_runs_top_k_then_sorted_by_speed(spark):
    rows = [(dt.datetime(2024, 1, d), dt.datetime(2024, 1, d, 1), float(10 - d)) for d in range(1, 8)]
    runs = spark.createDataFrame(rows, "start_time timestamp_ntz, end_time timestamp_ntz, "
                                       "eval_samples_per_second double")
    out = mon.latest_training_runs(runs, "2024-01-01 00:00:00", "2024-01-31 00:00:00", k=3).collect()
    assert [r["Start time"].day for r in out] == [7, 6, 5]
    assert [r["Evaluation sample/s"] for r in out] == [3.0, 4.0, 5.0]


def test_last_accuracy_skips_nulls(spark):
    rows = [(dt.datetime(2024, 1, 1), 0.5), (dt.datetime(2024, 1, 2), 0.9), (dt.datetime(2024, 1, 3), None)]
    runs = spark.createDataFrame(rows, "start_time timestamp_ntz, eval_accuracy double")
    r = mon.last_accuracy(runs, "2024-01-01 00:00:00", "2024-01-05 00:00:00").first()
    assert r.last_accuracy == 0.9

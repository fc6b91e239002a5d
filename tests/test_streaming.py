"""Streaming: stream = batch, incremental pickup, closed days vs. late rows."""

import datetime as dt
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sentiscope.operators import reputation as rep
from sentiscope.sources import segments as seg
from sentiscope.sources.tables import Tables
from sentiscope.streaming import jobs as stream

from conftest import SF001


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_reputation_equals_batch_over_many_batches(spark, scratch):
    landing = f"{scratch}/landing"
    stream.land_post_events(Tables(spark, SF001).raw("events"), landing, files_per_day=2)
    stream.stream_daily_reputation(spark, landing, f"{scratch}/silver", f"{scratch}/gold",
                                   f"{scratch}/ckpt", max_files=5)
    batch = rep.daily_reputation(Tables(spark, SF001).posts())
    assert rows(stream.read_gold(spark, f"{scratch}/gold")) == rows(batch)


def test_available_now_picks_up_only_new_files(spark, scratch):
    ev = Tables(spark, SF001).raw("events")
    landing, sink, ckpt = f"{scratch}/landing", f"{scratch}/sink", f"{scratch}/ckpt"
    cut = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    stream.land_post_events(ev.where(F.col("ts") < cut), landing)
    stream.stream_ingest(spark, landing, sink, ckpt)
    n1 = spark.read.parquet(sink).count()
    stream.land_post_events(ev.where(F.col("ts") >= cut), f"{scratch}/more")
    spark.read.parquet(f"{scratch}/more").write.mode("append").partitionBy("date").parquet(landing)
    stream.stream_ingest(spark, landing, sink, ckpt)
    assert n1 == ev.where(F.col("ts") < cut).count()
    assert spark.read.parquet(sink).count() == ev.count()
    stream.stream_ingest(spark, landing, sink, ckpt)  # nothing new: nothing added
    assert spark.read.parquet(sink).count() == ev.count()


def _land_day(spark, path, day, hours, sentiment="positive", start_id=0):
    ts = [dt.datetime(2024, 1, day, h) for h in hours]
    data = [(str(start_id + i), "u", sentiment, 0.9, None, t, t.date()) for i, t in enumerate(ts)]
    df = spark.createDataFrame(data, stream.POST_EVENT)
    df.coalesce(1).write.mode("append").partitionBy("date").parquet(path)


def test_closed_days_vs_late_rows(spark, scratch):
    landing = f"{scratch}/landing"
    _land_day(spark, landing, 1, [1, 2], start_id=0)
    _land_day(spark, landing, 2, [5], start_id=10)
    _land_day(spark, landing, 3, [23], start_id=20)
    _land_day(spark, landing, 3, [22], start_id=25)
    _land_day(spark, landing, 1, [3], sentiment="negative", start_id=30)  # late for day 1
    stream.stream_closed_days(spark, landing, f"{scratch}/closed", f"{scratch}/ck1", max_files=1)
    closed = spark.read.parquet(f"{scratch}/closed").collect()
    # Watermark after day 3 = day 3 23:00 - 1 day: day 1 is emitted in the fourth batch and
    # closed; the row for day 1 arriving in the fifth batch is too late and dropped.
    assert [(r.date, r.positive_count, r.negative_count) for r in closed] == [(dt.date(2024, 1, 1), 2, 0)]
    stream.stream_daily_reputation(spark, landing, f"{scratch}/silver", f"{scratch}/gold",
                                   f"{scratch}/ck2", max_files=1)
    days = {r.date: (r.positive_count, r.negative_count) for r in stream.read_gold(spark, f"{scratch}/gold").collect()}
    assert days[dt.date(2024, 1, 1)] == (2, 1)  # recompute keeps the late row


def test_dedup_stream_is_replay_safe(spark, scratch):
    landing = f"{scratch}/landing"
    _land_day(spark, landing, 1, [1, 2], start_id=0)
    _land_day(spark, landing, 1, [1, 2], start_id=0)  # the same posts landed again
    _land_day(spark, landing, 2, [1], start_id=5)
    stream.stream_dedup(spark, landing, f"{scratch}/sink", f"{scratch}/ck", max_files=1)
    assert sorted(r.id for r in stream.read_posts(spark, f"{scratch}/sink").collect()) == ["0", "1", "5"]


def test_watermark_dedup_drops_repeats_within_delay(spark, scratch):
    landing = f"{scratch}/landing"
    _land_day(spark, landing, 1, [1, 2], start_id=0)
    _land_day(spark, landing, 1, [1, 2], start_id=0)
    _land_day(spark, landing, 2, [1], start_id=5)
    stream.stream_dedup_watermark(spark, landing, f"{scratch}/sink", f"{scratch}/ck", max_files=1)
    assert sorted(r.id for r in spark.read.parquet(f"{scratch}/sink").collect()) == ["0", "1", "5"]


def test_update_mode_counts_over_ordered_batches(spark, scratch):
    landing = f"{scratch}/landing"
    _land_day(spark, landing, 1, [1, 2, 3], start_id=0)
    _land_day(spark, landing, 1, [4], sentiment="negative", start_id=10)
    _land_day(spark, landing, 2, [1, 2], start_id=20)
    stream.stream_daily_counts(spark, landing, f"{scratch}/log", f"{scratch}/ck", max_files=1)
    got = {(r.date.day, r.sentiment): r["count"] for r in stream.latest_counts(spark, f"{scratch}/log").collect()}
    assert got == {(1, "positive"): 3, (1, "negative"): 1, (2, "positive"): 2}
    # three batches were logged; the read side keeps the latest count per key
    assert seg.read(spark, f"{scratch}/log", stream.COUNTS_LOG).select("batch_id").distinct().count() == 3


def test_dedup_writer_replay_adds_nothing(spark, scratch):
    rows = [(str(i), "u", "positive", 0.9, None, dt.datetime(2024, 1, 1, i), dt.date(2024, 1, 1)) for i in range(3)]
    batch = spark.createDataFrame(rows, stream.POST_EVENT)
    write = stream.dedup_writer(spark, f"{scratch}/sink")
    write(batch, 0)
    write(batch, 0)  # the same micro-batch again, as after a failure
    assert stream.read_posts(spark, f"{scratch}/sink").count() == 3


def test_merged_logs_read_the_same_and_stay_small(spark, scratch):
    landing = f"{scratch}/landing"
    for n in range(20):
        _land_day(spark, landing, 1 + n % 3, [n], start_id=10 * n, sentiment="positive" if n % 4 else "negative")
    stream.stream_daily_counts(spark, landing, f"{scratch}/log", f"{scratch}/ck", max_files=1)
    got = {(r.date.day, r.sentiment): r["count"] for r in stream.latest_counts(spark, f"{scratch}/log").collect()}
    want = Counter((1 + n % 3, "positive" if n % 4 else "negative") for n in range(20))
    assert got == dict(want)
    live = seg.latest(spark, f"{scratch}/log").live
    assert len(live) <= 7 * 2 and max(s.tier for s in live) == 1
    folders = [n for n in os.listdir(f"{scratch}/log") if n.startswith("segment=")]
    assert len(folders) <= len(live) + 2 * seg.FAN  # merged ones go after some versions
    assert len(os.listdir(f"{scratch}/log/_manifest")) <= seg.KEEP + 2


def test_landing_splits_a_day_above_the_advisory_size(spark, scratch):
    import glob
    # AQE splits a big partition by ranges of map tasks: give the scan several of them,
    # as a large table has.
    ev = Tables(spark, SF001).raw("events").repartition(8)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "1k")
    try:
        stream.land_post_events(ev, f"{scratch}/landing")
    finally:
        spark.conf.set(key, old)
    landed = spark.read.parquet(f"{scratch}/landing")
    assert landed.count() == ev.count()
    files = [len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{scratch}/landing/date=*")]
    assert max(files) > 1  # a day bigger than the advisory size is written by several tasks


def _post(i, day, sentiment="positive", date="same"):
    t = dt.datetime(2024, 1, day, 1)
    return (i, "u", sentiment, 0.9, None, t, t.date() if date == "same" else date)


def test_copies_on_other_days_are_one_post_whatever_the_batches(spark, scratch):
    given = [_post("1", 1), _post("1", 2), _post("2", 1), _post("2", 1)]
    for name, cut in (("one", [given]), ("two", [given[:1] + given[2:3], given[1:2] + given[3:]])):
        write = stream.dedup_writer(spark, f"{scratch}/{name}")
        for n, part in enumerate(cut):
            write(spark.createDataFrame(part, stream.POST_EVENT), n)
        assert sorted(r.id for r in stream.read_posts(spark, f"{scratch}/{name}").collect()) == ["1", "2"]


def test_rows_without_id_or_date_are_rejects_once(spark, scratch):
    given = [_post("1", 1), _post("2", 1, date=None), _post(None, 1), _post(None, 2)]
    write = stream.dedup_writer(spark, f"{scratch}/sink")
    for _ in range(2):  # a replay
        write(spark.createDataFrame(given, stream.POST_EVENT), 0)
    assert [r.id for r in stream.read_posts(spark, f"{scratch}/sink").collect()] == ["1"]
    bad = stream.read_rejects(spark, f"{scratch}/sink").collect()
    assert sorted(r.reject_reason for r in bad) == ["missing_date", "missing_id", "missing_id"]


def test_late_posts_are_counted(spark, scratch):
    landing = f"{scratch}/landing"
    for n, day in enumerate([1, 7, 1, 2]):
        _land_day(spark, landing, day, [n], start_id=10 * n)
    stream.stream_daily_counts(spark, landing, f"{scratch}/log", f"{scratch}/ck", max_files=1)
    assert {(r.date.day, r["count"]) for r in stream.latest_counts(spark, f"{scratch}/log").collect()} == {(1, 2), (2, 1), (7, 1)}


def test_upserts_in_micro_batches_last_write_wins(spark, scratch):
    from sentiscope.schemas import POSTS, conform
    posts = conform(spark.createDataFrame([("1", None), ("2", "neutral"), ("3", None)], "id string, sentiment string"), POSTS)
    given = [("1", 2, "negative", 0.8, None), ("1", 1, "positive", 0.7, None), ("2", 1, None, None, "2"),
             ("2", 2, None, None, "x"), (None, 1, "neutral", 0.5, None), ("9", 1, "neutral", 0.5, None)]
    landing, log = f"{scratch}/landing", f"{scratch}/log"
    for row in given:  # a file each
        spark.createDataFrame([row], stream.UPDATE_EVENT).coalesce(1).write.mode("append").parquet(landing)
    for _ in range(2):  # the second run finds nothing new
        stream.stream_upsert(spark, landing, log, f"{scratch}/ck", max_files=1)
    got = {r.id: (r.sentiment, r.confidence, r.user_feedback) for r in stream.upserted(spark, posts, log).collect()}
    assert got == {"1": ("negative", 0.8, None), "2": ("neutral", None, "2"), "3": (None, None, None)}
    assert stream.upserted(spark, posts, f"{scratch}/none").count() == 3


def test_updates_that_are_not_written_are_kept_with_their_reason(spark, scratch):
    given = [("1", 1, "positive", 0.7, None), ("2", 1, None, None, "2"), ("2", 2, None, None, "x"), (None, 1, "neutral", 0.5, None),
             ("3", 1, "negative", 0.9, "7"), ("4", 1, None, None, None), (None, 2, None, None, "9")]
    landing, log = f"{scratch}/landing", f"{scratch}/log"
    for row in given:  # a file each
        spark.createDataFrame([row], stream.UPDATE_EVENT).coalesce(1).write.mode("append").parquet(landing)
    stream.stream_upsert(spark, landing, log, f"{scratch}/ck", max_files=3)
    want = {("2", 2, "x", "bad_feedback"), (None, 1, None, "missing_id"), ("3", 1, "7", "bad_feedback"),
            ("4", 1, None, "missing_value"), (None, 2, "9", "missing_id")}
    kept = lambda: sorted(((r.id, r.seq, r.answer, r.reject_reason) for r in spark.read.parquet(f"{log}-rejects").collect()), key=str)
    assert kept() == sorted(want, key=str)
    assert {(r.id, r.sentiment, r.answer) for r in spark.read.parquet(log).collect()} == {
        ("1", "positive", None), ("2", None, "2"), ("3", "negative", None)}
    stream.stream_upsert(spark, landing, log, f"{scratch}/ck-new", max_files=3)  # a replay replaces them
    assert kept() == sorted(want, key=str)


def test_reputation_batches_replay_and_late_days(spark, scratch):
    landing = f"{scratch}/landing"
    for n, (day, sentiment) in enumerate([(1, "positive"), (7, "negative"), (1, "negative"), (1, "positive")]):
        _land_day(spark, landing, day, [n], sentiment=sentiment, start_id=10 * n)
    _land_day(spark, landing, 9, [1], start_id=0)  # a copy of the first post on another day
    args = (spark, landing, f"{scratch}/silver", f"{scratch}/gold")
    stream.stream_daily_reputation(*args, f"{scratch}/ck", max_files=1)
    want = rows(stream.read_gold(spark, f"{scratch}/gold"))
    assert [(r[0].day, r[1], r[2]) for r in want if r[1] + r[2]] == [(1, 2, 1), (7, 0, 1)]
    # the same batches once more over what they stored, as after the loss of the checkpoint
    stream.stream_daily_reputation(*args, f"{scratch}/ck-new", max_files=1)
    assert rows(stream.read_gold(spark, f"{scratch}/gold")) == want


def test_copies_in_one_batch_leave_the_largest_row_and_old_ids_stay_out(spark, scratch):
    landing, sink, ck = f"{scratch}/landing", f"{scratch}/sink", f"{scratch}/ck"
    one = [_post("1", 1, "negative"), _post("1", 1, "positive"), _post("1", 2, "neutral"), _post("2", 1, None), _post(None, 3), _post("3", 4, date=None)]
    spark.createDataFrame(one, stream.POST_EVENT).repartition(3).write.parquet(landing)
    stream.stream_dedup(spark, landing, sink, ck)
    spark.createDataFrame([_post("1", 9, "positive"), _post("4", 1)], stream.POST_EVENT).write.mode("append").parquet(landing)
    stream.stream_dedup(spark, landing, sink, ck)
    got = {(r.id, r.sentiment, r.date.day) for r in stream.read_posts(spark, sink).collect()}
    assert got == {("1", "positive", 1), ("2", None, 1), ("4", "positive", 1)}
    assert sorted(r.reject_reason for r in stream.read_rejects(spark, sink).collect()) == ["missing_date", "missing_id"]


def test_a_batch_reads_nothing_of_what_is_stored(spark, scratch, monkeypatch):
    """The files a batch opens are its own and the manifest, however much is stored."""
    landing, sink, ck = f"{scratch}/landing", f"{scratch}/sink", f"{scratch}/ck"
    read = []
    real = seg.read_segments
    monkeypatch.setattr(seg, "read_segments", lambda spark_, root, segments, schema: read.append((root, len(list(segments)))) or real(spark_, root, segments, schema))
    for n in range(5):
        spark.createDataFrame([_post(str(10 * n + k), 1 + k) for k in range(10)], stream.POST_EVENT).coalesce(1).write.mode("append").parquet(landing)
        stream.stream_dedup(spark, landing, sink, ck)
    assert read == []
    assert real(spark, sink, seg.latest(spark, sink).live, stream.POST_EVENT).count() == 50


def test_a_lost_checkpoint_does_not_store_posts_twice(spark, scratch):
    landing, sink = f"{scratch}/landing", f"{scratch}/sink"
    spark.createDataFrame([_post(str(k), 1) for k in range(5)], stream.POST_EVENT).coalesce(1).write.parquet(landing)
    stream.stream_dedup(spark, landing, sink, f"{scratch}/ck")
    spark.createDataFrame([_post("3", 2), _post("9", 2)], stream.POST_EVENT).coalesce(1).write.mode("append").parquet(landing)
    stream.stream_dedup(spark, landing, sink, f"{scratch}/ck-new")  # one batch, cut otherwise
    assert sorted(r.id for r in stream.read_posts(spark, sink).collect()) == ["0", "1", "2", "3", "4", "9"]
    spark.createDataFrame([_post("9", 3), _post("0", 3), _post("10", 3)], stream.POST_EVENT).coalesce(1).write.mode("append").parquet(landing)
    stream.stream_dedup(spark, landing, sink, f"{scratch}/ck-new")
    assert sorted(r.id for r in stream.read_posts(spark, sink).collect()) == ["0", "1", "10", "2", "3", "4", "9"]


@pytest.mark.parametrize("dies", ["silver", "gold-deltas"])
def test_a_batch_that_died_half_way_is_counted_once(spark, scratch, monkeypatch, dies):
    landing = f"{scratch}/landing"
    _land_day(spark, landing, 1, [1, 2, 3], start_id=0)
    args = (spark, landing, f"{scratch}/silver", f"{scratch}/gold", f"{scratch}/ck")
    real = seg.append

    def append(df, root, *a, **k):
        made = real(df, root, *a, **k)
        if root.endswith(dies):
            raise RuntimeError("the driver is lost after this commit")
        return made

    monkeypatch.setattr(seg, "append", append)
    with pytest.raises(Exception):
        stream.stream_daily_reputation(*args)
    monkeypatch.undo()
    stream.stream_daily_reputation(*args)
    assert [(r.date.day, r.positive_count) for r in stream.read_gold(spark, f"{scratch}/gold").collect()] == [(1, 3)]
    assert stream.read_posts(spark, f"{scratch}/silver").count() == 3


def test_silver_segments_stay_few_over_many_batches(spark, scratch):
    landing = f"{scratch}/landing"
    for n in range(18):
        _land_day(spark, landing, 1 + n % 4, [n], start_id=10 * n)
    stream.stream_daily_reputation(spark, landing, f"{scratch}/silver", f"{scratch}/gold", f"{scratch}/ck", max_files=1)
    for root in (f"{scratch}/silver", f"{scratch}/gold-deltas"):
        assert len(seg.latest(spark, root).live) <= 8
    assert stream.read_posts(spark, f"{scratch}/silver").count() == 18
    assert {(r.date.day, r.positive_count) for r in stream.read_gold(spark, f"{scratch}/gold").collect()} == {(1, 5), (2, 5), (3, 4), (4, 4)}

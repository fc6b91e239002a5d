"""The daily lifecycle end to end on a warehouse folder: crawl, analyze, calculate, review, feedback, train."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sentiscope import jobs
from sentiscope.operators import reputation as rep
from sentiscope.sources import search_pages
from sentiscope.sources.tables import Tables

from conftest import SF001


def test_lifecycle(spark, scratch):
    wh = jobs.Warehouse(f"{scratch}/wh")
    docs = Tables(spark, SF001).posts_text()
    landing = f"{scratch}/landing"
    search_pages.land_search_pages(docs, landing, page_span=4)
    n_en = docs.where(F.col("lang") == "en").count()

    assert jobs.crawl(spark, wh, landing) == n_en
    assert jobs.crawl(spark, wh, landing) == 0  # rerun adds nothing
    assert wh.read_posts(spark).count() == n_en

    scored = jobs.analyze(spark, wh)
    posts = wh.read_posts(spark)
    assert scored == n_en and posts.where(F.col("sentiment").isNull()).count() == 0
    assert posts.count() == n_en  # only touched days rewritten, nothing lost or duplicated
    assert jobs.analyze(spark, wh) == 0

    assert jobs.calculate(spark, wh) is not None
    served = jobs.served(spark, wh, "reputation")
    expected = rep.daily_reputation(wh.read_posts(spark))
    assert sorted(map(tuple, served.collect())) == sorted(map(tuple, expected.collect()))

    queue = jobs.review_queue(spark, wh)
    ids = [r.id for r in queue.collect()]
    assert 0 < len(ids) <= 50
    answers = spark.createDataFrame([(i, 1, "2") for i in ids] + [(ids[0], 2, "x"), (None, 3, "1"), ("nobody", 4, "1"), (ids[1], 5, None)],
                                    "id string, seq int, answer string")
    assert jobs.save_feedback(spark, wh, answers) == len(ids)
    posts = wh.read_posts(spark)
    assert posts.where(F.col("user_feedback") == "2").count() == len(ids)
    assert posts.count() == n_en
    lost = jobs.seg.read(spark, wh.feedback_rejects, jobs.FEEDBACK_REJECTS).collect()
    assert sorted((r.seq, r.reject_reason) for r in lost) == [(2, "bad_feedback"), (3, "missing_id"), (4, "unknown_post"), (5, "bad_feedback")]
    assert jobs.served(spark, wh, "posts").where(F.col("user_feedback") == "2").count() == len(ids)

    result = jobs.train(spark, wh)
    assert 0.0 <= result["eval_accuracy"] <= 1.0
    assert (result["model_path"] is not None) == result["passed"]
    run, = jobs.served(spark, wh, "ledger").collect()
    assert run.eval_accuracy == result["eval_accuracy"] and run.epoch > 0 and run.eval_steps_per_second > 0
    log = jobs.logs.read_training_logs(spark, wh.logs).collect()
    assert {r.kind for r in log} == {"step", "eval", "summary"} and {r.run_time for r in log} == {run.start_time}
    steps = sorted((r.step, r.loss) for r in log if r.kind == "step")
    assert len(steps) == run.epoch + 1 and steps[-1][1] <= steps[0][1]


def _land(spark, path, rows, name):
    """A landed page: (id, text, day)."""
    os.makedirs(path, exist_ok=True)
    data = [{"id": i, "text": t, "author_id": "7", "created_at": f"2024-01-{d:02d}T10:00:00.000Z", "edit_history_tweet_ids": [i]} for i, t, d in rows]
    with open(f"{path}/{name}.json", "w") as fh:
        fh.write(json.dumps({"meta": {"result_count": len(data)}, "data": data}) + "\n")


def test_updates_touch_only_the_files_that_hold_an_id(spark, scratch):
    wh, landing = jobs.Warehouse(f"{scratch}/wh"), f"{scratch}/pages"
    for n in range(3):
        _land(spark, landing, [(str(1000 * n + k), "fine", 1 + 3 * n + k % 3) for k in range(30)], f"p{n}")
        assert jobs.crawl(spark, wh, landing) == 30
    before = set(wh.read_posts(spark).inputFiles())
    assert len(before) == 9  # three days in each of three segments
    assert len(jobs.seg.touched(spark, wh.posts, spark.createDataFrame([("1004",), ("1007",)], "id string"))) <= 2
    answers = spark.createDataFrame([("1004", 1, "2"), ("1007", 1, "0"), ("77777", 1, "1")], "id string, seq int, answer string")
    assert jobs.save_feedback(spark, wh, answers) == 2
    after = set(wh.read_posts(spark).inputFiles())
    assert len(before - after) == len(after - before) == 1  # both ids are of one day: its file was written anew, no other
    posts = {r.id: r.user_feedback for r in wh.read_posts(spark).collect()}
    assert len(posts) == 90 and {i: f for i, f in posts.items() if f} == {"1004": "2", "1007": "0"}
    assert jobs.analyze(spark, wh) == 90 and jobs.analyze(spark, wh) == 0
    assert wh.read_posts(spark).where("sentiment IS NULL").count() == 0 and wh.read_posts(spark).count() == 90


def test_an_update_that_dies_before_its_commit_changes_nothing(spark, scratch, monkeypatch):
    wh, landing = jobs.Warehouse(f"{scratch}/wh"), f"{scratch}/pages"
    _land(spark, landing, [("1", "good", 1), ("2", "bad", 2)], "a")
    jobs.crawl(spark, wh, landing)
    monkeypatch.setattr(jobs.seg, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        jobs.analyze(spark, wh)
    monkeypatch.undo()
    assert {r.sentiment for r in wh.read_posts(spark).collect()} == {None}
    assert jobs.analyze(spark, wh) == 2


def test_readers_see_a_job_whole_or_not_at_all(spark, scratch, monkeypatch):
    wh, landing = jobs.Warehouse(f"{scratch}/wh"), f"{scratch}/pages"
    _land(spark, landing, [("1", "good", 1)], "a")
    jobs.crawl(spark, wh, landing)
    jobs.calculate(spark, wh)
    real = jobs.publish_snapshot
    monkeypatch.setattr(jobs, "publish_snapshot", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        jobs.analyze(spark, wh)  # committed, not published
    assert [r.sentiment for r in jobs.served(spark, wh, "posts").collect()] == [None]
    monkeypatch.setattr(jobs, "publish_snapshot", real)
    jobs.calculate(spark, wh)
    assert [r.sentiment for r in jobs.served(spark, wh, "posts").collect()] != [None]


def test_crawl_by_keywords_and_marks(spark, scratch, monkeypatch):
    from sentiscope.sources import corpus
    wh, landing = jobs.Warehouse(f"{scratch}/wh"), f"{scratch}/pages"
    with open(f"{scratch}/keywords.txt", "w") as f:
        f.write("Brand\n\nother firm \n")
    words = lambda: corpus.read_keywords(spark, f"{scratch}/keywords.txt")
    _land(spark, landing, [("100", "my brand", 1), ("101", "nothing", 1), ("102", "RT @x brand", 1), ("103", "the OTHER FIRM", 2)], "a")
    real = jobs.seg._commit
    calls = []

    def once(spark_, root, m):
        if root == wh.posts and not calls:
            calls.append(1)
            raise RuntimeError("driver lost before the batch is committed")
        real(spark_, root, m)

    monkeypatch.setattr(jobs.seg, "_commit", once)
    with pytest.raises(Exception):
        jobs.crawl(spark, wh, landing, keywords=words())
    assert wh.read_posts(spark) is None and wh.read_marks(spark).count() == 0
    assert jobs.crawl(spark, wh, landing, keywords=words()) == 2
    marks = lambda: {r.keyword: r.last_id for r in wh.read_marks(spark).collect()}
    assert marks() == {"brand": 100, "other firm": 103}
    # 99 lies below its mark, 100 is known, 104 is new
    _land(spark, landing, [("99", "brand of old", 3), ("100", "my brand", 1), ("104", "brand new", 3)], "b")
    assert jobs.crawl(spark, wh, landing, keywords=words()) == 1
    assert marks() == {"brand": 104, "other firm": 103}
    assert sorted(r.id for r in wh.read_posts(spark).collect()) == ["100", "103", "104"]
    lost = {(r.id, r.reject_reason) for r in jobs.seg.read(spark, wh.rejects, jobs.REJECTS).collect()}
    assert lost == {("101", "no_new_match"), ("102", "repost"), ("99", "no_new_match")}


def test_a_lost_crawl_checkpoint_stores_no_post_twice(spark, scratch):
    import shutil
    wh, landing = jobs.Warehouse(f"{scratch}/wh"), f"{scratch}/pages"
    _land(spark, landing, [("1", "good", 1), ("2", "bad", 2)], "a")
    jobs.crawl(spark, wh, landing)
    jobs.analyze(spark, wh)  # rewritten files still count as that crawl's
    shutil.move(f"{wh.root}/_checkpoints", f"{wh.root}/_lost")
    _land(spark, landing, [("2", "bad", 2), ("3", "new", 3)], "b")
    assert jobs.crawl(spark, wh, landing) == 1
    assert sorted(r.id for r in wh.read_posts(spark).collect()) == ["1", "2", "3"]


def test_crawl_sends_undated_posts_to_rejects(spark, scratch):
    import json
    import os
    wh = jobs.Warehouse(f"{scratch}/wh")
    landing = f"{scratch}/pages"
    os.makedirs(landing)
    page = {"meta": {"result_count": 2}, "data": [
        {"id": "11", "text": "good service", "author_id": "7", "created_at": "2024-01-05T10:00:00.000Z",
         "edit_history_tweet_ids": ["11"]},
        {"id": "12", "text": "no date", "author_id": "7", "created_at": "yesterday",
         "edit_history_tweet_ids": ["12"]}]}
    with open(f"{landing}/page-1.json", "w") as fh:
        fh.write(json.dumps(page) + "\n")
    assert jobs.crawl(spark, wh, landing) == 1
    assert [r.id for r in wh.read_posts(spark).collect()] == ["11"]
    rej = jobs.seg.read(spark, wh.rejects, jobs.REJECTS).collect()
    assert [(r.id, r.reject_reason) for r in rej] == [("12", "missing_date")]


def test_jobs_on_an_empty_warehouse_stop_early(spark, scratch):
    wh = jobs.Warehouse(f"{scratch}/none")
    answers = spark.createDataFrame([("1", 1, "2")], "id string, seq int, answer string")
    assert jobs.analyze(spark, wh) == 0
    assert jobs.calculate(spark, wh) is None
    assert jobs.review_queue(spark, wh).collect() == []
    assert jobs.save_feedback(spark, wh, answers) == 0
    assert jobs.train(spark, wh)["passed"] is False


def test_a_second_corpus_leaves_no_old_split(spark, scratch):
    from sentiscope.sources import corpus
    schema = "id string, text string, label int, split string"
    for rows in ([("1", "a", 0, "train"), ("2", "b", 1, "test")], [("3", "c", 0, "train")]):
        corpus.write_split_corpus(spark.createDataFrame(rows, schema), f"{scratch}/c")
    assert [r.id for r in spark.read.parquet(f"{scratch}/c").collect()] == ["3"]


def test_ties_do_not_depend_on_row_order(spark):
    from sentiscope.operators import ingest, monitoring, updates
    rows = [("1", 1, "b", 0.1), ("1", 1, "a", 0.9)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "id string, seq int, sentiment string, confidence double").coalesce(1)
        assert [r.sentiment for r in updates.last_write_per_key(df, "id", "seq", ["sentiment", "confidence"]).collect()] == ["b"]
        assert [r.sentiment for r in ingest.new_only(df, df.limit(0)).collect()] == ["b"]
        runs = df.selectExpr("timestamp_ntz'2024-01-01 00:00:00' AS start_time",
                             "timestamp_ntz'2024-01-01 01:00:00' AS end_time", "confidence AS eval_accuracy")
        assert monitoring.last_accuracy(runs, "2024-01-01 00:00:00", "2024-01-02 00:00:00").first().last_accuracy == 0.9


def test_the_published_snapshot_is_readable_while_a_crawl_merges(spark, scratch, monkeypatch):
    monkeypatch.setattr(jobs.seg, "FAN", 2)
    monkeypatch.setattr(jobs.seg.append, "__defaults__", tuple(2 if d == 8 else 1 if d == 4 else d for d in jobs.seg.append.__defaults__))
    wh, landing = jobs.Warehouse(f"{scratch}/wh"), f"{scratch}/pages"
    for n in range(6):  # merged at once, and what was merged away deleted one version later
        _land(spark, landing, [(str(10 * n + k), "fine", 1 + k) for k in range(2)], f"p{n}")
        assert jobs.crawl(spark, wh, landing) == 2
        assert jobs.served(spark, wh, "posts").count() == 2 * n + 2
    assert len(jobs.seg.latest(spark, wh.posts).live) <= 3


def test_a_crawl_reads_its_batch_once(spark, scratch, monkeypatch):
    """The pages and the state of a batch are read once, however often the job uses its rows."""
    wh, landing = jobs.Warehouse(f"{scratch}/wh"), f"{scratch}/pages"
    _land(spark, landing, [(str(k), "my brand" if k % 2 else "nothing", 1 + k % 3) for k in range(40)], "a")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    real = jobs.stream.first_seen
    monkeypatch.setattr(jobs.stream, "first_seen", lambda posts: (lambda df: df.mapInArrow(counted, df.schema))(real(posts)))
    words = spark.createDataFrame([("brand",), ("firm",)], "keyword string")
    assert jobs.crawl(spark, wh, landing, keywords=words) == 20
    assert read.value == 40
    assert {r.keyword: r.last_id for r in wh.read_marks(spark).collect()} == {"brand": 39}

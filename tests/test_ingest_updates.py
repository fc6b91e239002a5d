"""Ingest, dedup, updates by key, cleaning: D7-D10, JON-05, idempotence, dirty inputs."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from sentiscope.functions.dates import clean_date
from sentiscope.functions.keys import digits_key
from sentiscope.functions.text import clean_account
from sentiscope.operators import ingest as ing
from sentiscope.operators import updates as upd
from sentiscope.schemas import POSTS, conform, schema_matches
from sentiscope.sources import history_csv as hcsv
from sentiscope.sources import search_pages as pages
from sentiscope.sources import training_logs as logs

POST_SCHEMA = "id string, sentiment string, confidence double, user_feedback string"


def test_updates_last_write_wins_and_idempotent(spark):
    base = spark.createDataFrame([("1", None, None, None), ("2", "neutral", 0.6, None)], POST_SCHEMA)
    scores = spark.createDataFrame([("1", 1, "neutral", 0.5), ("1", 3, "negative", 0.9),
                                    ("1", 2, "positive", 0.7)],
                                   "id string, seq int, sentiment string, confidence double")
    once = upd.apply_scores(base, scores)
    twice = upd.apply_scores(once, scores)
    got = {r.id: (r.sentiment, r.confidence) for r in once.collect()}
    assert got == {"1": ("negative", 0.9), "2": ("neutral", 0.6)}  # D9
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_feedback_validation_and_canonical_text(spark):
    base = spark.createDataFrame([("1", "positive", 0.4, None), ("2", "negative", 0.3, None)], POST_SCHEMA)
    answers = spark.createDataFrame([("1", 1, "2"), ("1", 2, "7"), ("2", 1, " 0 ")],
                                    "id string, seq int, answer string")
    got = {r.id: r.user_feedback for r in upd.apply_feedback(base, answers).collect()}
    assert got == {"1": "2", "2": "0"}  # FLT-10: '7' rejected, last valid answer wins
    _, rejected = upd.split_feedback(answers)
    assert [r.answer for r in rejected.collect()] == ["7"]


def test_new_only_dedups_in_batch_and_against_known(spark):
    known = spark.createDataFrame([("1",), ("2",)], "id string")
    batch = spark.createDataFrame([("2", "x"), ("3", "y"), ("3", "y"), ("4", "z")], "id string, t string")
    assert sorted(r.id for r in ing.new_only(batch, known).collect()) == ["3", "4"]
    # rerun of the same batch after appending adds nothing
    stored = known.unionByName(ing.new_only(batch, known).select("id"))
    assert ing.new_only(batch, stored).count() == 0


def test_high_water_mark_compares_as_bigint(spark):
    rows = [("kw", "1234567890123456789"), ("kw", "999"), ("kw", "1234567890123456790")]
    df = spark.createDataFrame(rows, "keyword string, id string")
    assert ing.high_water_marks(df).first().last_id == 1234567890123456790  # D7
    marks = ing.high_water_marks(df.where(F.col("id") == "999"))
    new = ing.since_marks(df, marks, "keyword", "id")
    assert new.count() == 2


def _contained(posts, keywords):
    return sorted({(k, i) for i, lang, t in posts if lang == "en" and t and not t.startswith("RT @") for k in keywords if k in t.lower()}, key=str)


def test_keywords_of_every_length_are_found(spark):
    texts = [("1", "en", "The cat"), ("2", "en", "RT @x the dog"), ("3", "fr", "the"), ("4", "en", "Unique queue"),
             ("5", "en", "an ox"), ("6", "en", ""), ("7", "en", None), ("8", "en", "Théâtre ox-he"), ("9", "en", "x" * 50000 + "the cat"),
             ("10", "en", "日本語のテキスト"), ("1", "en", "the cat again"), (None, "en", "oxen")]
    posts = spark.createDataFrame(texts, "id string, lang string, text string")
    words = ["the", " QUE ", "ox", "", "he", "théâ", "x", "é", "日本", "語", "the cat", "unique queue", "xxthe c", "nowhere", "cat\u0000", "ne q"]
    kws = ing.keyword_table(spark, words)
    want = _contained(texts, {w.strip().lower() for w in words} - {""})
    assert sorted(map(tuple, ing.keyword_match(posts, kws).collect()), key=str) == sorted(want, key=str)
    assert ing.keyword_match(posts, ing.keyword_table(spark, [])).count() == 0
    assert ing.keyword_match(posts.limit(0), kws).count() == 0


def test_thousands_of_keywords_and_split_grams(spark):
    from sentiscope.operators import keywords as kw
    rng = random.Random(3)
    texts = [(str(i), "en", " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(40))) for i in range(60)]
    words = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9))).strip() for _ in range(3000)} - {""})
    posts = spark.createDataFrame(texts, "id string, lang string, text string").repartition(3)
    lc = posts.select("id", F.lower("text").alias("lc"))
    kws = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = _contained(texts, words)
    assert len(want) > 3000
    for split in (1, 7, 10 ** 6):  # hot grams in many places, or none
        assert sorted(map(tuple, kw.match(lc, kws, split).collect()), key=str) == want


def test_conform_adds_typed_nulls_and_history(spark):
    df = spark.createDataFrame([(123, "hello", dt.date(2024, 1, 2))], "id long, text string, date date")
    c = conform(df, POSTS)
    assert schema_matches(c, POSTS)
    r = c.first()
    assert r.id == "123" and r.edit_history_tweet_ids == ["123"] and r.sentiment is None


def test_surrogate_keys_have_h_digits_and_are_stable(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    k12 = df.select(digits_key(F.col("k"), 12, "p:").alias("x"))
    assert k12.where((F.col("x") < 10 ** 11) | (F.col("x") >= 10 ** 12)).count() == 0
    assert k12.exceptAll(df.select(digits_key(F.col("k"), 12, "p:").alias("x"))).count() == 0


def test_clean_dates_and_accounts(spark):
    raw = [(" 2024-03-05",), ("05/03/2024",), ("2024-03-05",), ("n/a",), (None,)]
    got = [r[0] for r in spark.createDataFrame(raw, "r string").select(clean_date(F.col("r"))).collect()]
    d = dt.date(2024, 3, 5)
    assert got == [d, d, d, None, None]
    acc = [(" @brand",), ("@brand\u200b",), ("@brand\U000e0020",), ("@brand \t",), ("@brand\u00a0",)]
    got = {r[0] for r in spark.createDataFrame(acc, "a string").select(clean_account(F.col("a"))).collect()}
    assert got == {"@brand"}


DIRTY_CSV = (
    "author,author account,date,text\n"
    "Ann, @ann, 2024-01-02,plain text\n"
    "Bob,@bob,2024-01-02,\"quoted, with comma\"\n"
    "Cid,@cid,2024-01-03,stray quote at end\"\n"
    "Dan,@dan,2024-01-03,\"opening quote never closed\n"
    "Eve,@eve,2024-01-04,swallowed by the reference, kept here\n"
    "Fay,@fay,2024-01-04,\"real\nline break\"\n"
    "Gus,@gus,04/01/2024,\"doubled \"\"quotes\"\"\"\n"
)


def test_tolerant_csv_reader_keeps_every_record(spark, scratch):
    p = os.path.join(scratch, "hist.csv")
    with open(p, "w") as f:
        f.write(DIRTY_CSV)
    rows = hcsv.read_history_csv(spark, p).collect()
    texts = [r.text for r in rows]
    assert len(rows) == 7
    assert texts == ["plain text", "quoted, with comma", 'stray quote at end"', "opening quote never closed",
                     "swallowed by the reference, kept here", "real\nline break", 'doubled "quotes"']
    days = [r[0] for r in hcsv.read_history_csv(spark, p).select(clean_date(F.col("date"))).collect()]
    assert days.count(None) == 0


def test_csv_roundtrip_through_spark_writer(spark, scratch):
    rows = [("a", "@a", "2024-01-01", 'x "y", z\nw  '), ("b", "@b", "01/02/2024", "  lead")]
    df = spark.createDataFrame(rows, "author string, `author account` string, date string, text string")
    hcsv.write_history_csv(df, f"{scratch}/out")
    back = sorted(map(tuple, hcsv.read_history_csv(spark, f"{scratch}/out").collect()))
    strict = sorted(map(tuple, hcsv.read_history_csv_strict(spark, f"{scratch}/out").collect()))
    assert back == strict == sorted(rows)


def test_search_pages_skip_empty_and_flatten(spark, scratch):
    d = os.path.join(scratch, "landing")
    os.makedirs(d)
    page = {"data": [{"id": "1234567890123456789", "text": "hi", "author_id": "42",
                      "created_at": "2025-11-20T10:00:00.000Z", "edit_history_tweet_ids": ["1234567890123456789"]}],
            "meta": {"result_count": 1, "newest_id": "1234567890123456789"}}
    with open(os.path.join(d, "p1.json"), "w") as f:
        json.dump(page, f, indent=2)
    with open(os.path.join(d, "p2.json"), "w") as f:
        json.dump({"meta": {"result_count": 0}}, f, indent=2)
    rows = pages.posts_from_pages(pages.read_search_pages(spark, d, multi_line=True)).collect()
    assert len(rows) == 1 and rows[0].date == dt.date(2025, 11, 20) and rows[0].sentiment is None


def test_training_log_arrays_and_run_time_from_name(spark, scratch):
    d = os.path.join(scratch, "logs")
    os.makedirs(d)
    log = [{"loss": 0.9, "grad_norm": 3.1, "learning_rate": 2e-5, "epoch": 0.5, "step": 29},
           {"eval_loss": 0.06, "eval_accuracy": 0.96, "eval_f1": 0.96, "eval_runtime": 9.2,
            "eval_samples_per_second": 2.8, "eval_steps_per_second": 0.8, "epoch": 1.0, "step": 58},
           {"train_runtime": 122.8, "train_samples_per_second": 1.9, "train_steps_per_second": 0.5,
            "total_flos": 1.0e13, "train_loss": 0.7, "epoch": 1.0, "step": 58}]
    with open(os.path.join(d, "train_log20251127_075200.json"), "w") as f:
        json.dump(log, f, indent=4)
    rows = logs.read_training_logs(spark, d).collect()
    assert [r.kind for r in rows] == ["step", "eval", "summary"]
    assert rows[0].run_time == dt.datetime(2025, 11, 27, 7, 52, 0)


def test_keyword_file_and_split_corpus(spark, scratch):
    from sentiscope.sources import corpus
    p = os.path.join(scratch, "keywords.txt")
    with open(p, "w") as f:
        f.write("brand\n  Customer Care \n\nbrand\n")
    assert sorted(r.keyword for r in corpus.read_keywords(spark, p).collect()) == ["brand", "customer care"]
    df = spark.createDataFrame([("1", "a", 0, "train"), ("2", "b", 1, "test")],
                               "id string, text string, label int, split string")
    corpus.write_split_corpus(df, f"{scratch}/corpus")
    assert [r.id for r in corpus.read_split_corpus(spark, f"{scratch}/corpus", "test").collect()] == ["2"]


def test_restrict_to_days_prunes_and_matches_semi_join(spark, scratch):
    from pyspark.sql import functions as F
    from sentiscope.sources.tables import restrict_to_days
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int"))
    spark.range(3000).select(F.col("id").cast("string").alias("id"), day.alias("date")) \
        .write.partitionBy("date").parquet(f"{scratch}/t")
    t = spark.read.parquet(f"{scratch}/t")
    batch = spark.range(0, 200, 7).select(F.lit("x").alias("id"), day.alias("date")) \
        .unionByName(spark.sql("SELECT 'y' AS id, CAST(NULL AS DATE) AS date"))
    want = sorted(r.id for r in t.join(batch.select("date"), "date", "left_semi").collect())
    few = restrict_to_days(t, batch)
    scan = few._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert ">=" in scan.partitionFilters().toString() and "<=" in scan.partitionFilters().toString()
    assert sorted(r.id for r in few.collect()) == want
    assert restrict_to_days(t, batch.where("date IS NULL")).count() == 0


def test_outcomes_written_by_one_job_with_reasons(spark, scratch):
    import datetime as dt
    from sentiscope.operators import quality as qa
    rows = [("1", dt.date(2024, 1, 1), "positive", None), ("2", None, "negative", None),
            ("3", dt.date(2024, 1, 2), "meh", None), ("4", dt.date(2024, 1, 2), None, "2.0"),
            ("5", dt.date(2024, 1, 3), "neutral", "maybe")]
    df = spark.createDataFrame(rows, "id string, date date, sentiment string, user_feedback string")
    qa.write_outcomes(df, f"{scratch}/out")
    got = {(r.id, r.outcome, r.reject_reason) for r in spark.read.parquet(f"{scratch}/out").collect()}
    assert got == {("1", "accepted", None), ("2", "rejected", "missing_date"),
                   ("3", "rejected", "unknown_sentiment"), ("4", "accepted", None),
                   ("5", "rejected", "bad_feedback")}


def test_tolerant_csv_loses_no_record(spark, scratch):
    import os
    from sentiscope.sources import history_csv as hcsv
    lines = ['author,author account,date,text',
             'Ann,@ann,n/a,first record without a date',
             '"Smith, Jo",@jo,2025-01-02,"quoted, with ""marks"" and',
             'Bob,@bob,2025-01-03,a line that looks like a record"',
             'Cyd,@cyd ,2025-01-04,blank after the handle',
             'Dee,@dee,2025-1-5,odd date',
             'Eve,@eve,2025-01-06,"never closed',
             'second line',
             'Flo,@flo,2025-01-07,a "stray" quote',
             'no record at all',
             'Gus,gus,2025-01-08,no at sign']
    os.makedirs(f"{scratch}/csv")
    with open(f"{scratch}/csv/a.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    got = {tuple(r) for r in hcsv.read_history_csv(spark, f"{scratch}/csv").collect()}
    assert got == {
        ("Ann", "@ann", "n/a", "first record without a date"),
        ("Smith, Jo", "@jo", "2025-01-02", 'quoted, with "marks" and\nBob,@bob,2025-01-03,a line that looks like a record'),
        ("Cyd", "@cyd ", "2025-01-04", "blank after the handle"),
        ("Dee", "@dee", "2025-1-5", "odd date"),
        ("Eve", "@eve", "2025-01-06", "never closed\nsecond line"),
        ("Flo", "@flo", "2025-01-07", 'a "stray" quote'),
        (None, None, None, "no record at all"),
        ("Gus", "gus", "2025-01-08", "no at sign")}


def _sent(texts, words):
    """What the tasks send for a list of texts: (bytes, ids) rows."""
    import numpy as np
    import pyarrow as pa
    from sentiscope.operators import keywords as kw
    bits, most = 20, max(len(w.encode()) for w in words)
    filter_ = np.zeros(1 << (bits - 6), np.uint64)
    for b in kw._enter(bits)([pa.RecordBatch.from_pydict({"kb": pa.array([w.encode() for w in words], pa.binary())})]):
        np.bitwise_or.at(filter_, b.column("word").to_numpy(), b.column("value").to_numpy().view(np.uint64))

    class Shared:
        value = (filter_, bits, most)

    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(len(texts))], "lc": texts, "place": pa.array([0] * len(texts), pa.int64())})
    return [(r["kb"].decode(errors="replace"), r["ids"]) for b in kw._occur(Shared)([batch]) for r in b.to_pylist()]


def test_a_keyword_is_sent_once_for_all_texts_of_a_piece():
    """Keywords that share all their grams: what is sent is the pairs there are, whatever the list's length."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 12))) for _ in range(1500)})
    texts = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(50)]
    sent = _sent(texts, words)
    pairs = {(w, str(i)) for i, t in enumerate(texts) for w in words if w in t}
    got = [(w, i) for w, ids in sent for i in ids]
    assert len(got) == len(set(got)) and pairs <= set(got) and len(got) < 1.01 * len(pairs)
    assert len(sent) == len({w for w, _ in got}) <= 1.01 * len(words)


def test_equal_codes_of_long_keywords_are_told_apart(monkeypatch):
    import numpy as np
    from sentiscope.operators import keywords as kw
    real = kw._longer
    monkeypatch.setattr(kw, "_longer", lambda code, byte, size: real(code, byte, size) if size <= kw.EXACT else np.full(len(code), size, np.uint64))
    words = ["brand of cars", "brand of bikes", "cars of brand", "other firm"]
    texts = ["brand of cars, brand of bikes, cars of brand, brand of cars, brand of bikes", "cars of brand brand of cars", "no other firm"]
    got = [(w, i) for w, ids in _sent(texts, words) for i in ids]
    assert len(got) == len(set(got))
    assert {(w, i) for w, i in got if w in words} == {(w, str(i)) for i, t in enumerate(texts) for w in words if w in t}


def test_ids_in_several_rows_match_once(spark):
    from sentiscope.operators import keywords as kw
    rows = [("1", "the cat"), ("1", "a cat"), (None, "cat"), (None, "the"), ("2", "the dog"), ("3", "dog")]
    texts = spark.createDataFrame(rows, "id string, lc string").repartition(3)
    kws = spark.createDataFrame([("cat",), ("the",), ("dog",), ("bird",)], "keyword string")
    want = sorted({(k, i) for i, t in rows for k in ("cat", "the", "dog") if k in t}, key=str)
    for split in (1, 10 ** 6):
        assert sorted(map(tuple, kw.match(texts, kws, split).collect()), key=str) == want

"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through the fixture views) so its work
grows with them. Keys follow SURVEY §2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import clean_date, ledger_time
from ..functions.keys import digits_key, history_text
from ..functions.labels import argmax, canonical_label, class_name
from ..functions.text import clean_account, fixed_length_ids, words
from ..operators import evaluation as ev
from ..operators import ingest as ing
from ..operators import labelling as lab
from ..operators import monitoring as mon
from ..operators import naive_bayes as nb
from ..operators import quality as qa
from ..operators import reputation as rep
from ..operators import review as rv
from ..operators import scoring as sc
from ..operators import training as tr
from ..operators import updates as upd
from ..schemas import DAILY_REPUTATION, POSTS, conform, schema_report
from ..session import scratch_path
from ..sources import corpus
from ..sources import history_csv as hcsv
from ..sources import search_pages as pages
from ..sources import segments as seg
from ..sources import sinks
from ..sources import training_logs as logs
from ..sources.tables import Tables
from ..streaming import jobs as stream
from .. import jobs
from . import params as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


# ---- reputation (AGG-01..04) -------------------------------------------------

@query("daily_reputation")
def q_daily_reputation(spark, sf):
    return rep.daily_reputation(Tables(spark, sf).posts())


@query("daily_reputation_closed")
def q_daily_reputation_closed(spark, sf):
    return rep.daily_reputation_closed(Tables(spark, sf).posts())


@query("counts_by_day_class")
def q_counts_by_day_class(spark, sf):
    return rep.counts_by_day_class(Tables(spark, sf).posts())


@query("class_counts_pivot")
def q_class_counts_pivot(spark, sf):
    return rep.class_counts_pivot(Tables(spark, sf).posts())


@query("weights_from_text")
def q_weights_from_text(spark, sf):
    return rep.daily_reputation_weighted_by_text(Tables(spark, sf).posts(), P.WEIGHTS_TEXT)


# ---- scans and filters on posts (SRC-04, FLT-01/05/06) -------------------------

@query("scan_posts")
def q_scan_posts(spark, sf):
    posts = Tables(spark, sf).posts()
    return (mon.in_date_range(posts, P.DAY_LO, P.DAY_HI)
            .where(F.col("sentiment").isNotNull())
            .select("id", "date", "sentiment", "confidence"))


@query("first_posts")
def q_first_posts(spark, sf):
    return mon.first_rows(Tables(spark, sf).posts().select("id", "date", "sentiment"))


@query("sorted_counts")
def q_sorted_counts(spark, sf):
    return mon.positions(rep.counts_by_day_class(Tables(spark, sf).posts()).orderBy("date", "sentiment"))


@query("schema_check")
def q_schema_check(spark, sf):
    """The posts as a job has stored them against the schema they should have."""
    path = scratch_path(spark, "posts-table")
    seg.append(conform(Tables(spark, sf).posts(), POSTS), path, POSTS, partition_by="date")
    return schema_report(seg.read(spark, path), POSTS)


@query("pending_posts")
def q_pending_posts(spark, sf):
    return Tables(spark, sf).posts().where(F.col("sentiment").isNull()).select("id", "author_id", "date")


@query("posts_in_range")
def q_posts_in_range(spark, sf):
    return mon.in_date_range(Tables(spark, sf).posts(), P.DAY_LO, P.DAY_HI).select("id", "date", "sentiment")


@query("posts_last_30_days")
def q_posts_last_30_days(spark, sf):
    posts = Tables(spark, sf).posts()
    return mon.last_n_days(posts, 30).groupBy("date").agg(F.count(F.lit(1)).alias("count"))


@query("posts_last_7_days")
def q_posts_last_7_days(spark, sf):
    posts = Tables(spark, sf).posts()
    return mon.last_n_days(posts, P.LAST_DAYS).select("id", "date", "sentiment")


@query("epoch_ms")
def q_epoch_ms(spark, sf):
    return Tables(spark, sf).posts().select(
        "id", "date", F.unix_millis(F.col("date").cast("timestamp")).alias("epoch_ms"))


# ---- monitoring panels (§2.14) ---------------------------------------------------

@query("post_count_in_range")
def q_post_count_in_range(spark, sf):
    return mon.post_count_in_range(Tables(spark, sf).posts(), P.DAY_LO, P.DAY_HI)


@query("class_counts_in_range")
def q_class_counts_in_range(spark, sf):
    return mon.class_counts_in_range(Tables(spark, sf).posts(), P.DAY_LO, P.DAY_HI)


@query("posts_per_day")
def q_posts_per_day(spark, sf):
    return mon.posts_per_day(Tables(spark, sf).posts(), P.DAY_LO, P.DAY_HI)


@query("reputation_series")
def q_reputation_series(spark, sf):
    daily = rep.daily_reputation(Tables(spark, sf).posts())
    return mon.reputation_series(daily, P.DAY_LO, P.DAY_HI)


@query("mean_reputation_in_range")
def q_mean_reputation_in_range(spark, sf):
    daily = rep.daily_reputation(Tables(spark, sf).posts())
    return mon.mean_reputation_in_range(daily, P.DAY_LO, P.DAY_HI)


@query("mean_confidence_in_range")
def q_mean_confidence_in_range(spark, sf):
    return mon.mean_confidence_in_range(Tables(spark, sf).posts(), P.DAY_LO, P.DAY_HI)


@query("reputation_bands")
def q_reputation_bands(spark, sf):
    return mon.reputation_bands(Tables(spark, sf).posts(), P.DAY_LO, P.DAY_HI)


@query("latest_negative")
def q_latest_negative(spark, sf):
    return mon.latest_negative(Tables(spark, sf).posts_text(), P.DAY_LO, P.DAY_HI, P.TOP_NEGATIVE)


@query("sample_posts")
def q_sample_posts(spark, sf):
    return mon.sample_posts(Tables(spark, sf).posts_text(), P.DAY_LO, P.DAY_HI)


# ---- run ledger panels -----------------------------------------------------------

@query("latest_training_runs")
def q_latest_training_runs(spark, sf):
    return mon.latest_training_runs(Tables(spark, sf).training_runs(), P.RUN_LO, P.RUN_HI, P.TOP_RUNS)


@query("sorted_training_runs")
def q_sorted_training_runs(spark, sf):
    runs = mon.latest_training_runs(Tables(spark, sf).training_runs(), P.RUN_LO, P.RUN_HI, P.TOP_RUNS)
    return mon.positions(runs).select("position", F.col("Start time").alias("start_time"), F.col("Evaluation sample/s").alias("speed"))


@query("last_training_run")
def q_last_training_run(spark, sf):
    return mon.last_training_run(Tables(spark, sf).training_runs(), P.RUN_LO, P.RUN_HI)


@query("last_accuracy")
def q_last_accuracy(spark, sf):
    return mon.last_accuracy(Tables(spark, sf).training_runs(), P.RUN_LO, P.RUN_HI)


@query("accuracy_bands")
def q_accuracy_bands(spark, sf):
    return mon.accuracy_bands(Tables(spark, sf).training_runs(), P.RUN_LO, P.RUN_HI)


@query("run_metric_series")
def q_run_metric_series(spark, sf):
    return mon.run_metric_series(Tables(spark, sf).training_runs(), P.RUN_LO, P.RUN_HI)


@query("train_seconds")
def q_train_seconds(spark, sf):
    return mon.train_seconds(Tables(spark, sf).training_runs(), P.RUN_LO, P.RUN_HI)


# ---- evaluation on predictions (AGG-14..17, FLT-09, TOP-05) ----------------------

@query("accuracy")
def q_accuracy(spark, sf):
    return ev.accuracy(Tables(spark, sf).predictions())


@query("macro_f1")
def q_macro_f1(spark, sf):
    return ev.macro_f1(Tables(spark, sf).predictions())


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return ev.confusion_matrix(Tables(spark, sf).predictions())


@query("misclassified")
def q_misclassified(spark, sf):
    return ev.misclassified(Tables(spark, sf).predictions(), 10)


@query("misclassified_all")
def q_misclassified_all(spark, sf):
    return ev.misclassified(Tables(spark, sf).predictions())


@query("misclassification_rate")
def q_misclassification_rate(spark, sf):
    return ev.misclassification_rate(Tables(spark, sf).predictions())


# ---- labels, splits, profiles (ML-01..03, AGG-11..13, AGG-19, DQ) -----------------

def _labels(spark, sf):
    return lab.training_labels(Tables(spark, sf).posts())


def _split(spark, sf):
    return lab.train_val_test_split(_labels(spark, sf), "id", P.SPLIT_SEED, P.TEST_SHARE, P.VALIDATION_SHARE)


@query("training_labels")
def q_training_labels(spark, sf):
    return _labels(spark, sf)


@query("train_val_test_split")
def q_train_val_test_split(spark, sf):
    return _split(spark, sf)


@query("stratified_split")
def q_stratified_split(spark, sf):
    """D21 option: the exact cut inside every class."""
    return lab.train_val_test_split(_labels(spark, sf), "id", P.SPLIT_SEED, P.TEST_SHARE,
                                    P.VALIDATION_SHARE, stratify_by="label")


@query("split_sizes")
def q_split_sizes(spark, sf):
    return lab.split_sizes(_split(spark, sf))


@query("split_class_counts")
def q_split_class_counts(spark, sf):
    return lab.split_class_counts(_split(spark, sf))


@query("distribution_matrix")
def q_distribution_matrix(spark, sf):
    return lab.distribution_matrix(_split(spark, sf))


def _text_labels(spark, sf):
    pt = Tables(spark, sf).posts_text().withColumn("user_feedback", F.lit(None).cast("string"))
    return lab.training_labels(pt)


@query("class_balance")
def q_class_balance(spark, sf):
    return lab.class_balance(_text_labels(spark, sf))


@query("quality_report")
def q_quality_report(spark, sf):
    pt = Tables(spark, sf).posts_text().where(F.col("sentiment").isNotNull())
    return qa.quality_report(pt.select(canonical_label(F.col("sentiment")).alias("label")))


def historic_batch(posts_text):
    """Document rows as a historic batch: dirty day text cleaned (unparsable -> NULL date),
    reviewer feedback typed by hand (every seventh row is not a valid answer)."""
    k = F.col("id").cast("bigint")
    fb = F.when(k % 7 == 0, F.lit("maybe")).when(k % 7 == 1, F.lit("2.0"))
    return posts_text.select("id", "author_id", "sentiment", fb.alias("user_feedback"),
                             clean_date(raw_date()).alias("date"))


@query("rejects_by_reason")
def q_rejects_by_reason(spark, sf):
    t = Tables(spark, sf)
    return qa.rejects_by_reason(ing.union_batches(t.posts(), historic_batch(t.posts_text())))


# ---- review and updates by key (TOP-01, JON-01/02) --------------------------------

@query("review_queue")
def q_review_queue(spark, sf):
    t = Tables(spark, sf)
    return rv.review_queue(t.posts(), P.REVIEW_THRESHOLD, P.REVIEW_LIMIT, t.posts_text())


def score_updates(posts):
    """Two writes per pending post: a provisional one and the final one (last wins)."""
    pending = posts.where(F.col("sentiment").isNull()).select("id")
    k = F.col("id").cast("bigint")
    first = pending.select("id", F.lit(1).alias("seq"), F.lit("neutral").alias("sentiment"),
                           F.lit(0.5).alias("confidence"))
    final = pending.select(
        "id", F.lit(2).alias("seq"),
        F.when(F.pmod(k, F.lit(3)) == 0, "negative").when(F.pmod(k, F.lit(3)) == 1, "neutral")
         .otherwise("positive").alias("sentiment"),
        (F.lit(0.6) + F.pmod(k, F.lit(40)).cast("double") / F.lit(100.0)).alias("confidence"))
    return first.unionByName(final)


def feedback_answers(posts):
    """Two reviewer answers per reviewable post; the second is invalid for every fourth id."""
    cand = posts.where(F.col("sentiment").isNotNull() & F.col("user_feedback").isNull()
                       & (F.col("confidence") < F.lit(P.REVIEW_THRESHOLD))).select("id")
    k = F.col("id").cast("bigint")
    a1 = cand.select("id", F.lit(1).alias("seq"), F.pmod(k, F.lit(3)).cast("string").alias("answer"))
    a2 = cand.select("id", F.lit(2).alias("seq"),
                     F.when(F.pmod(k, F.lit(4)) == 0, F.lit("x"))
                      .otherwise(F.pmod(k + 1, F.lit(3)).cast("string")).alias("answer"))
    return a1.unionByName(a2)


@query("apply_scores")
def q_apply_scores(spark, sf):
    posts = Tables(spark, sf).posts()
    return upd.apply_scores(posts, score_updates(posts)).select("id", "sentiment", "confidence")


@query("apply_feedback")
def q_apply_feedback(spark, sf):
    posts = Tables(spark, sf).posts()
    return upd.apply_feedback(posts, feedback_answers(posts)).select("id", "user_feedback")


# ---- ingest (FLT-07/08, JON-05..07, AGG-20) -----------------------------------------

@query("keyword_match")
def q_keyword_match(spark, sf):
    return ing.keyword_match(Tables(spark, sf).posts_text(), ing.keyword_table(spark, P.KEYWORDS))


@query("keyword_match_list")
def q_keyword_match_list(spark, sf):
    """A long list, read from a keyword file: the first word of every document."""
    posts, path = Tables(spark, sf).posts_text(), scratch_path(spark, "keywords")
    posts.select(F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0).alias("value")).where(F.length("value") > 0).write.text(path)
    return ing.keyword_match(posts, corpus.read_keywords(spark, path))


@query("high_water_marks")
def q_high_water_marks(spark, sf):
    matched = ing.keyword_match(Tables(spark, sf).posts_text(), ing.keyword_table(spark, P.KEYWORDS))
    return ing.high_water_marks(matched)


@query("incremental_since_id")
def q_incremental_since_id(spark, sf):
    ev_ = Tables(spark, sf).raw("events")
    seen = ev_.where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    marks = ing.high_water_marks(seen, "event_type", "event_id")
    return ing.since_marks(ev_.select("event_id", "event_type"), marks, "event_type", "event_id")


@query("append_new_only")
def q_append_new_only(spark, sf):
    posts = Tables(spark, sf).posts()
    known = posts.where(F.col("date") < F.lit("2024-01-20").cast("date"))
    fresh = posts.where(F.col("date") >= F.lit("2024-01-15").cast("date"))
    batch = fresh.unionByName(fresh)  # the crawl fetched every row twice
    return ing.new_only(batch, known).select("id", "date", "sentiment")


# ---- scalar functions and cleaning (SCL, CLN, PRJ) -----------------------------------

@query("json_field")
def q_json_field(spark, sf):
    e = Tables(spark, sf).raw("events")
    return e.select("event_id", F.from_json("props", "k BIGINT").getField("k").alias("k"))


@query("argmax_label")
def q_argmax_label(spark, sf):
    emb = Tables(spark, sf).raw("embeddings")
    pred = argmax(F.col("embedding"))
    return emb.select("vec_id", "label", pred.alias("pred"), class_name(pred).alias("pred_name"))


def raw_date():
    """The day of a document in one of four spellings, some of them no date."""
    k = F.pmod(F.col("id").cast("bigint"), F.lit(8))
    iso = F.date_format("date", "yyyy-MM-dd")
    return (F.when(k % 4 == 0, F.concat(F.lit(" "), iso))
            .when(k % 4 == 1, F.date_format("date", "dd/MM/yyyy"))
            .when(k % 4 == 2, iso)
            .when(k == 3, F.lit("n/a"))
            .otherwise(F.concat(iso, F.lit(" "))))


@query("clean_dates")
def q_clean_dates(spark, sf):
    d = Tables(spark, sf).posts_text().select("id", raw_date().alias("raw_date"))
    return d.select("id", "raw_date", clean_date(F.col("raw_date")).alias("date"))


def dirty_accounts(posts_text):
    k = F.pmod(F.col("id").cast("bigint"), F.lit(4))
    a = F.col("author_id")
    raw = (F.when(k == 0, F.concat(F.lit(" @"), a))
           .when(k == 1, F.concat(F.lit("@"), a, F.lit("\u200b")))
           .when(k == 2, F.concat(F.lit("@"), a))
           .otherwise(F.concat(F.lit("@"), a, F.lit(" \t"))))
    return posts_text.select("id", raw.alias("raw_account"))


@query("clean_accounts")
def q_clean_accounts(spark, sf):
    d = dirty_accounts(Tables(spark, sf).posts_text())
    return (d.select(clean_account(F.col("raw_account")).alias("account"))
            .groupBy("account").agg(F.count(F.lit(1)).alias("posts")))


@query("conform_posts")
def q_conform_posts(spark, sf):
    batch = Tables(spark, sf).posts_text().select("id", "author_id", "text", "date")
    return conform(batch, POSTS)


@query("surrogate_keys")
def q_surrogate_keys(spark, sf):
    pt = Tables(spark, sf).posts_text()
    post_key = digits_key(F.col("id"), 12, "post:")
    return pt.select("id", post_key.alias("post_key"),
                     digits_key(F.col("author_id"), 9, "author:").alias("author_key"),
                     history_text(post_key).alias("edit_history_text"))


@query("tokenize_fixed")
def q_tokenize_fixed(spark, sf):
    pt = Tables(spark, sf).posts_text()
    toks = words(F.col("text"))
    ids, mask = fixed_length_ids(toks, P.MAX_LENGTH)
    return pt.select("id", ids.alias("input_ids"), mask.alias("attention_mask"),
                     F.size(toks).alias("n_tokens"))


@query("score_posts_lexicon")
def q_score_posts_lexicon(spark, sf):
    return sc.lexicon_scores(Tables(spark, sf).posts_text())


@query("score_posts")
def q_score_posts(spark, sf):
    pending = Tables(spark, sf).posts_text().where(F.col("sentiment").isNull())
    return sc.score_posts(pending)


# ---- sources and sinks (SRC-01/03/06, SNK-01..08) ----------------------------------------
# Keys that write use a fresh folder under the session's checkpoint dir and return
# what they read back.

@query("ingest_search_pages")
def q_ingest_search_pages(spark, sf):
    path = scratch_path(spark, "landing-search")
    pages.land_search_pages(Tables(spark, sf).posts_text(), path, page_span=4)
    return pages.posts_from_pages(pages.read_search_pages(spark, path))


def history_rows(posts_text):
    """Historic CSV rows derived from the documents (some days in dd/MM/yyyy)."""
    k = F.col("id").cast("bigint")
    raw_date = F.when(k % 10 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(
        F.date_format("date", "yyyy-MM-dd"))
    return posts_text.select(F.col("author_id").alias("author"),
                             F.concat(F.lit("@"), F.col("author_id")).alias("author account"),
                             raw_date.alias("date"), "text")


def posts_from_history(rows):
    """Shape historic rows into silver posts: deterministic 12/9-digit keys (PRJ-08)."""
    natural = F.concat_ws("|", F.col("author account"), F.col("date"), F.col("text"))
    post_key = digits_key(natural, 12, "post:").cast("string")
    return conform(rows.select(post_key.alias("id"),
                               digits_key(F.col("author account"), 9, "author:").cast("string").alias("author_id"),
                               "text", clean_date(F.col("date")).alias("date")), POSTS)


@query("ingest_history_csv")
def q_ingest_history_csv(spark, sf):
    path = scratch_path(spark, "landing-history")
    hcsv.write_history_csv(history_rows(Tables(spark, sf).posts_text()), path)
    return posts_from_history(hcsv.read_history_csv(spark, path))


@query("training_log_rows")
def q_training_log_rows(spark, sf):
    path = scratch_path(spark, "training-logs")
    logs.write_training_logs(logs.log_rows_from_runs(Tables(spark, sf).training_runs()), path)
    rows = logs.read_training_logs(spark, path, multi_line=False)
    return rows.select("run_time", "kind", "epoch", "step", "eval_loss", "eval_accuracy", "train_runtime")


@query("append_posts")
def q_append_posts(spark, sf):
    posts = Tables(spark, sf).posts()
    cut = F.lit("2024-01-16").cast("date")
    path = scratch_path(spark, "posts-table")
    early = posts.where(F.col("date") < cut)
    late = posts.where(F.col("date") >= cut).select("id", "author_id", "date")  # a batch without scores
    for batch in (early, late):
        sinks.append(conform(batch, POSTS), path, partition_by="date")
    return (sinks.read_table(spark, path, POSTS)
            .select("id", "author_id", "date", "sentiment", "confidence", "user_feedback"))


@query("publish_reputation")
def q_publish_reputation(spark, sf):
    root = scratch_path(spark, "reputation")
    daily = rep.daily_reputation(Tables(spark, sf).posts())
    sinks.publish(daily, root, DAILY_REPUTATION)
    return sinks.serving(spark, root, DAILY_REPUTATION)


def ledger_rows(runs):
    """Ledger rows with text times (SCL-13) and evaluated rows (AGG-21)."""
    return runs.select(
        ledger_time(F.col("start_time")).alias("start_time"),
        ledger_time(F.col("end_time")).alias("end_time"),
        "eval_loss", "eval_accuracy", "eval_runtime", "eval_samples_per_second",
        F.round(F.col("eval_runtime") * F.col("eval_samples_per_second")).cast("long").alias("eval_rows"))


@query("append_training_run")
def q_append_training_run(spark, sf):
    runs = Tables(spark, sf).training_runs()
    path = scratch_path(spark, "training-ledger")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    for part in (runs.where(F.col("start_time") < cut), runs.where(F.col("start_time") >= cut)):
        sinks.append(ledger_rows(part), path)
    return spark.read.parquet(path)


# ---- training, evaluation, gate (ML-07..10) ------------------------------------------------

def _text_split(spark, sf):
    pt = Tables(spark, sf).posts_text().withColumn("user_feedback", F.lit(None).cast("string"))
    labelled = lab.training_labels(pt, keep_cols=("id", "text"))
    return lab.train_val_test_split(labelled, "id", P.SPLIT_SEED, P.TEST_SHARE, P.VALIDATION_SHARE)


@query("train_evaluate")
def q_train_evaluate(spark, sf):
    _, result = nb.train_evaluate(_text_split(spark, sf))
    return spark.createDataFrame([result], RESULT_SCHEMA)


@query("train_logistic")
def q_train_logistic(spark, sf):
    _, result = tr.train_evaluate(_text_split(spark, sf))
    return spark.createDataFrame([result], LOGISTIC_SCHEMA)


@query("split_corpus")
def q_split_corpus(spark, sf):
    """The labelled corpus written by split and read back, its rows counted."""
    path = scratch_path(spark, "corpus")
    corpus.write_split_corpus(_text_split(spark, sf), path)
    return lab.split_class_counts(corpus.read_split_corpus(spark, path))


@query("naive_bayes_predictions")
def q_naive_bayes_predictions(spark, sf):
    return nb.predict_split(_text_split(spark, sf))


@query("naive_bayes_macro_f1")
def q_naive_bayes_macro_f1(spark, sf):
    return ev.macro_f1(nb.predict_split(_text_split(spark, sf)))


@query("train_gate")
def q_train_gate(spark, sf):
    """Both sides of the gate: the run is in the ledger either way, the model only past the gate, and a reloaded model predicts alike."""
    corpus_path, ledger = scratch_path(spark, "corpus"), scratch_path(spark, "gate-ledger")
    corpus.write_split_corpus(_text_split(spark, sf), corpus_path)  # SNK-06, read back as SRC-05
    split = corpus.read_split_corpus(spark, corpus_path)
    out = []
    model, result = nb.train_evaluate(split)
    for threshold in P.GATES:
        sinks.append(spark.createDataFrame([{**result, "threshold": threshold}], RESULT_SCHEMA + ", threshold double"), ledger)  # before the gate (D19)
        passed, rows, reloaded = tr.gate(result, threshold), 0, None
        if passed:
            root = scratch_path(spark, "model")
            nb.save_model(model, root)
            again, smoothing = nb.load_model(spark, root)
            rows = again.where("kind = 'word'").count()
            reloaded = nb.metrics(nb.predict(again, split.where("split = 'test'"), (smoothing,))).first()["eval_accuracy"]
        out.append((threshold, passed, rows, reloaded))
    gates = spark.createDataFrame(out, "threshold double, passed boolean, model_rows long, reloaded_accuracy double")
    return spark.read.parquet(ledger).join(gates, "threshold").select(
        "threshold", "eval_loss", "eval_accuracy", "eval_f1", "test_rows", "smoothing", "passed", "model_rows", "reloaded_accuracy")


RESULT_SCHEMA = "eval_loss double, eval_accuracy double, eval_f1 double, test_rows long, smoothing double, val_f1 double"
LOGISTIC_SCHEMA = ("eval_loss double, eval_accuracy double, eval_f1 double, eval_runtime double, "
                   "eval_samples_per_second double, test_rows long, reg_param double, val_f1 double")


# ---- the jobs over a warehouse -----------------------------------------------------------------

def _crawled(spark, sf):
    """Two crawls by keyword: first the pages of the older half of the posts, then the others land too."""
    posts = Tables(spark, sf).posts_text()
    root, landing, words = (scratch_path(spark, n) for n in ("warehouse", "landing-pages", "keywords"))
    middle = posts.agg(F.expr("percentile_approx(CAST(id AS BIGINT), 0.5)")).first()[0] or 0
    spark.createDataFrame([(k,) for k in P.KEYWORDS], "value string").write.text(words)
    wh = jobs.Warehouse(root)
    for part in (F.col("id").cast("long") <= middle, F.col("id").cast("long") > middle):
        pages.land_search_pages(posts.where(part), landing, mode="append")
        jobs.crawl(spark, wh, landing, keywords=corpus.read_keywords(spark, words))
    return wh


@query("crawl_posts")
def q_crawl_posts(spark, sf):
    return _crawled(spark, sf).read_posts(spark).select("id", "date", "author_id")


@query("crawl_marks")
def q_crawl_marks(spark, sf):
    return _crawled(spark, sf).read_marks(spark)


@query("feedback_files")
def q_feedback_files(spark, sf):
    """Reviewer answers written into the files that hold their posts, found by the index of ids."""
    posts, root = Tables(spark, sf).posts(), scratch_path(spark, "warehouse")
    wh = jobs.Warehouse(root)
    cut = F.lit("2024-01-16").cast("date")
    for part in (posts.where(F.col("date") < cut), posts.where(F.col("date") >= cut)):
        seg.append(conform(part, POSTS), wh.posts, POSTS, partition_by="date", index_by="id")
    jobs.save_feedback(spark, wh, feedback_answers(posts))
    return jobs.served(spark, wh, "posts").select("id", "user_feedback")


# ---- streaming (STR-01..07) ---------------------------------------------------------------------

def _landing(spark, sf, name="landing-posts", files_per_day=1):
    path = scratch_path(spark, name)
    stream.land_post_events(Tables(spark, sf).raw("events"), path, files_per_day)
    return path


@query("stream_ingest")
def q_stream_ingest(spark, sf):
    landing, sink = _landing(spark, sf), scratch_path(spark, "stream-ingest")
    stream.stream_ingest(spark, landing, sink, scratch_path(spark, "ckpt"), max_files=10)
    return spark.read.schema(stream.POST_EVENT).parquet(sink).select("id", "date", "sentiment")


@query("stream_dedup")
def q_stream_dedup(spark, sf):
    landing = _landing(spark, sf)
    ev_ = Tables(spark, sf).raw("events")
    stream.land_post_events(ev_, landing + "-dups", 1)
    # Every post arrives a second time, as extra files in the same landing folder.
    spark.read.parquet(landing + "-dups").write.mode("append").partitionBy("date").parquet(landing)
    sink = scratch_path(spark, "stream-dedup")
    stream.stream_dedup(spark, landing, sink, scratch_path(spark, "ckpt"), max_files=20)
    return stream.read_posts(spark, sink).select("id", "date", "sentiment")


@query("stream_upsert")
def q_stream_upsert(spark, sf):
    posts = Tables(spark, sf).posts()
    landing, log = scratch_path(spark, "landing-updates"), scratch_path(spark, "stream-updates")
    updates = score_updates(posts).unionByName(feedback_answers(posts), allowMissingColumns=True)
    # dealt by a hash, so that the writes of one id come in different batches, in any order
    (updates.withColumn("seq", F.col("seq").cast("long")).repartition(6, F.xxhash64("id", "seq"))
     .select(*stream.UPDATE_EVENT.fieldNames()).write.parquet(landing))
    stream.stream_upsert(spark, landing, log, scratch_path(spark, "ckpt"), max_files=2)
    return stream.upserted(spark, posts, log).select("id", "sentiment", "confidence", "user_feedback")


@query("stream_daily_counts")
def q_stream_daily_counts(spark, sf):
    landing, sink = _landing(spark, sf, files_per_day=2), scratch_path(spark, "stream-counts")
    # many batches, and the files of a day in no order: late posts are counted too
    stream.stream_daily_counts(spark, landing, sink, scratch_path(spark, "ckpt"), max_files=7)
    return stream.latest_counts(spark, sink)


@query("stream_daily_reputation")
def q_stream_daily_reputation(spark, sf):
    landing = _landing(spark, sf)
    silver, gold = scratch_path(spark, "stream-silver"), scratch_path(spark, "stream-gold")
    stream.stream_daily_reputation(spark, landing, silver, gold, scratch_path(spark, "ckpt"), max_files=10)
    return stream.read_gold(spark, gold)


@query("stream_score")
def q_stream_score(spark, sf):
    landing = scratch_path(spark, "landing-text")
    pending = Tables(spark, sf).posts_text().where(F.col("sentiment").isNull()).select("id", "text")
    pending.repartition(4).write.parquet(landing)
    sink = scratch_path(spark, "stream-score")
    stream.stream_score(spark, landing, pending.schema, sink, scratch_path(spark, "ckpt"), max_files=2)
    return spark.read.parquet(sink)


@query("stream_closed_days")
def q_stream_closed_days(spark, sf):
    landing, sink = _landing(spark, sf), scratch_path(spark, "stream-closed")
    stream.stream_closed_days(spark, landing, sink, scratch_path(spark, "ckpt"))
    return spark.read.parquet(sink)

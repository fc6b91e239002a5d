"""Table-level jobs of the daily lifecycle, composed from the operators.

The reference runs five scripts over one SQLite file: crawl, analyze, calculate,
feedback, train. Here each is a Spark job over a warehouse folder:

* ``silver/posts``      posts, partitioned by ``date``, with the crawl's marks and an index of the ids in each file
* ``gold/reputation``   the daily index, replaced as a whole
* ``ledger``            one appended row per training run
* ``models/<id>``       models that passed the gate, ``logs`` a log of each run
* ``rejects``, ``feedback-rejects``   rows that were not stored, with their reason
* ``serving``           the published snapshot: which version of each table readers get

All tables grow by commits of a manifest (``sources.segments``): a job writes new files, then the manifest
that names them, then the snapshot. A job that dies before its commit has changed nothing, a reader sees the state before or
after a job, and no file is ever overwritten. Updates by key write anew only the files that hold one of the ids.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .functions.labels import canonical_feedback
from .operators import ingest as ing
from .operators import labelling as lab
from .operators import quality as qa
from .operators import reputation as rep
from .operators import review as rv
from .operators import training as tr
from .operators import updates as upd
from .operators.scoring import score_posts
from .schemas import DAILY_REPUTATION, POSTS, SEARCH_RESPONSE, TRAINING_RUNS, conform
from .sources import corpus, search_pages, segments as seg, training_logs as logs
from .streaming import jobs as stream

REJECTS = T.StructType(POSTS.fields + [T.StructField("reject_reason", T.StringType())])
FEEDBACK_REJECTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()),
                                 T.StructField("answer", T.StringType()), T.StructField("reject_reason", T.StringType())])
SNAPSHOT = T.StructType([T.StructField("name", T.StringType()), T.StructField("path", T.StringType()),
                         T.StructField("without", T.ArrayType(T.StringType()))])
MARKS = T.StructType([T.StructField("keyword", T.StringType()), T.StructField("last_id", T.LongType())])


@dataclass(frozen=True)
class Warehouse:
    root: str

    @property
    def posts(self) -> str:
        return f"{self.root}/silver/posts"

    @property
    def reputation(self) -> str:
        return f"{self.root}/gold/reputation"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def feedback_rejects(self) -> str:
        return f"{self.root}/feedback-rejects"

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def logs(self) -> str:
        return f"{self.root}/logs"

    @property
    def serving(self) -> str:
        return f"{self.root}/serving"

    def checkpoint(self, landing: str) -> str:
        return f"{self.root}/_checkpoints/crawl-{hashlib.md5(landing.encode()).hexdigest()[:12]}"

    def model(self) -> str:
        return f"{self.root}/models/{uuid.uuid4().hex}"

    def read_posts(self, spark: SparkSession) -> DataFrame | None:
        live = seg.latest(spark, self.posts).live
        return seg.read_segments(spark, self.posts, live, POSTS) if live else None

    def read_marks(self, spark: SparkSession) -> DataFrame:
        """The largest id crawled for each keyword, as of the last committed batch."""
        path = seg.latest(spark, self.posts).extra
        return spark.read.schema(MARKS).parquet(f"{self.posts}/{path}") if path else spark.createDataFrame([], MARKS)


# ---- publishing (SNK-05) ---------------------------------------------------------------

PUBLISHED = {"posts": POSTS, "reputation": DAILY_REPUTATION, "ledger": TRAINING_RUNS}


def publish_snapshot(spark: SparkSession, wh: Warehouse) -> None:
    """Commits which segments of each table readers get from now on; nothing is copied. Every job ends with it."""
    rows = [(name, s.path, list(s.without)) for name in PUBLISHED for s in seg.latest(spark, getattr(wh, name)).live]
    if rows:
        seg.replace(spark.createDataFrame(rows, SNAPSHOT), wh.serving, SNAPSHOT)


def served(spark: SparkSession, wh: Warehouse, name: str) -> DataFrame:
    """A table as of the last published snapshot."""
    rows = seg.read(spark, wh.serving, SNAPSHOT).where(F.col("name") == name).collect()
    return seg.read_segments(spark, getattr(wh, name), [seg.Segment(r.path, without=tuple(r.without)) for r in rows], PUBLISHED[name])


# ---- jobs ------------------------------------------------------------------------------


def _matching(batch: DataFrame, keywords: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FLT-07, JON-06/07, FLT-08: (ids of the posts that hold a keyword and lie above its mark, the marks after them, what both
    are made of, kept until it is unpersisted)."""
    found = ing.keyword_match(batch, keywords, lang=None)
    fresh = ing.since_marks(found, marks, "keyword", "id").persist()
    both = ing.high_water_marks(fresh).unionByName(marks)
    return fresh.select("id").distinct(), both.groupBy("keyword").agg(F.max("last_id").alias("last_id")), fresh


def crawl(spark: SparkSession, wh: Warehouse, landing: str, multi_line: bool = False, keywords: DataFrame | None = None) -> int:
    """Crawl job: landed search pages -> new posts appended, each id once; returns how many.

    Only pages landed since the last run are read, and the ids seen are keyed state of the job's checkpoint, so a run
    costs what is new. With ``keywords`` (``read_keywords``) only posts that hold one and lie above its mark are
    stored, and reposts are not; the marks are committed with the posts they come from, so a run that died and is
    repeated neither skips nor repeats an id. What is not stored goes to ``rejects`` with its reason.
    """
    checkpoint = wh.checkpoint(landing)
    pages = spark.readStream.schema(SEARCH_RESPONSE).option("multiLine", multi_line).json(landing)
    posts = search_pages.posts_from_pages(pages.where(F.col("meta.result_count") > 0).select(F.inline("data")))
    stored: list[int] = []

    def commit(batch: DataFrame, batch_id: int) -> None:
        name = stream.stream_id(spark, checkpoint)
        before = seg.latest(spark, wh.posts)
        # each read of ``batch`` reads its pages and asks the state again, so it is read once
        rows = conform(batch, REJECTS).withColumn("reject_reason", qa.reject_reason(batch)).persist()
        held = [rows]
        foreign = [s for s in before.live if s.origin is not None and s.origin != name]
        if foreign:  # another checkpoint's posts: this one's state has not seen them
            known = seg.read_segments(spark, wh.posts, foreign, POSTS).select("id").distinct()
            rows = rows.join(known, "id", "left_anti").select(*REJECTS.fieldNames())
        extra = None
        if keywords is not None:
            usable = rows.where("reject_reason IS NULL")
            ids, marks, fresh = _matching(usable, keywords, wh.read_marks(spark))
            held.append(fresh)
            extra = f"marks-{uuid.uuid4().hex[:12]}"
            marks.write.parquet(f"{wh.posts}/_marks/{extra}")
            extra = f"_marks/{extra}"
            ids = ids.withColumn("_hit", F.lit(True))
            reason = (F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
                      .when(F.coalesce(F.col("text").rlike(ing.REPOST), F.lit(False)), F.lit("repost"))
                      .when(F.col("_hit").isNull(), F.lit("no_new_match")))
            rows = rows.join(ids, "id", "left").withColumn("reject_reason", reason).select(*REJECTS.fieldNames())
        if rows is not held[0]:
            held.append(rows.persist())
        seg.append(rows.where("reject_reason IS NOT NULL"), wh.rejects, REJECTS, name, batch_id)
        accepted = rows.where("reject_reason IS NULL")
        if seg.append(accepted, wh.posts, POSTS, name, batch_id, partition_by="date", extra=extra, index_by="id"):
            stored.append(accepted.count())
        publish_snapshot(spark, wh)  # with every batch: files that merging has replaced are deleted some versions later
        for df in held:
            df.unpersist()

    seen = stream.first_seen(posts)
    stream.run_available(seen.writeStream.foreachBatch(commit), checkpoint)
    return sum(stored)


def _update(spark: SparkSession, wh: Warehouse, files: list[str], change) -> None:
    """Writes these files of the posts anew, changed, and publishes."""
    if files:
        rows = seg.read_files(spark, wh.posts, files, POSTS)
        seg.rewrite(change(rows), wh.posts, POSTS, files, partition_by="date", index_by="id")
    publish_snapshot(spark, wh)


def analyze(spark: SparkSession, wh: Warehouse, model_factory=None) -> int:
    """Score job: score pending posts and write sentiment/confidence back, in the files that hold pending ones."""
    live = seg.latest(spark, wh.posts).live
    if not live:  # FLT-11: nothing was crawled yet
        return 0
    pending = seg.read_segments(spark, wh.posts, live, POSTS, with_file=True).where(F.col("sentiment").isNull())
    files = [r["_file"] for r in pending.select("_file").distinct().collect()]
    if not files:
        return 0
    staged = f"{wh.root}/staging/{uuid.uuid4().hex}"
    score_posts(pending.drop("_file"), model_factory).withColumn("seq", F.lit(1)).write.parquet(staged)
    scores = spark.read.parquet(staged)
    _update(spark, wh, files, lambda rows: upd.apply_scores(rows, scores))
    return scores.count()


def calculate(spark: SparkSession, wh: Warehouse, weights=rep.DEFAULT_WEIGHTS) -> str | None:
    """Index job: recompute the daily index and publish it (skipped on empty input)."""
    posts = wh.read_posts(spark)
    if posts is None:
        return None
    made = seg.replace(conform(rep.daily_reputation(posts, weights), DAILY_REPUTATION), wh.reputation, DAILY_REPUTATION)
    if made is None:
        return None
    publish_snapshot(spark, wh)
    return f"{wh.reputation}/{made.live[0].path}"


def review_queue(spark: SparkSession, wh: Warehouse, threshold: float = 0.8, k: int = 50) -> DataFrame:
    posts = wh.read_posts(spark)
    return rv.review_queue(spark.createDataFrame([], POSTS) if posts is None else posts, threshold, k)


def save_feedback(spark: SparkSession, wh: Warehouse, answers: DataFrame) -> int:
    """Feedback job: reviewer answers (id, seq, answer) -> ``user_feedback``, in the files that hold one of the ids. Answers
    that are not accepted, name no id or a post that is not stored go to ``feedback-rejects`` with their reason (FLT-10)."""
    posts = wh.read_posts(spark)
    if posts is None:
        return 0
    valid = upd.split_feedback(answers)[0].where(F.col("id").isNotNull())
    files = seg.touched(spark, wh.posts, valid)
    known = seg.read_files(spark, wh.posts, files, POSTS).select("id").distinct()
    stored = valid.join(known, "id", "left_semi").select("id").distinct()
    path = f"{wh.root}/staging/{uuid.uuid4().hex}"
    stored.write.parquet(path)
    stored = spark.read.parquet(path)
    accepted = canonical_feedback(F.col("answer")).isNotNull()
    reason = (F.when(F.col("id").isNull(), F.lit("missing_id")).when(~accepted, F.lit("bad_feedback"))
              .when(F.col("_stored").isNull(), F.lit("unknown_post")))
    rejects = (answers.join(stored.withColumn("_stored", F.lit(True)), "id", "left").withColumn("reject_reason", reason)
               .where("reject_reason IS NOT NULL"))
    seg.append(conform(rejects, FEEDBACK_REJECTS), wh.feedback_rejects, FEEDBACK_REJECTS)
    _update(spark, wh, files if not stored.isEmpty() else [], lambda rows: upd.apply_feedback(rows, answers))
    return stored.count()


def train(spark: SparkSession, wh: Warehouse, seed: int = 42, threshold: float = tr.ACCURACY_GATE) -> dict:
    """Training job: labels (feedback first) -> exact split -> fit/select/evaluate ->
    log and ledger row (always, before the gate) -> model saved only past the gate."""
    posts = wh.read_posts(spark)
    if posts is None or posts.where(F.col("sentiment").isNotNull()).isEmpty():
        return {"passed": False, "model_path": None}
    start = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    labelled = lab.training_labels(posts, keep_cols=("id", "text"))
    corpus_path = f"{wh.root}/corpus/{uuid.uuid4().hex}"
    corpus.write_split_corpus(lab.train_val_test_split(labelled, seed=seed), corpus_path)
    model, result = tr.train_evaluate(corpus.read_split_corpus(spark, corpus_path))
    end = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    logs.write_run_log(spark, tr.log_rows(result, (end - start).total_seconds()), wh.logs, start)
    row = {"start_time": start, "end_time": end, **{f.name: result.get(f.name) for f in TRAINING_RUNS.fields[2:]}}
    seg.append(spark.createDataFrame([tuple(row[n] for n in TRAINING_RUNS.fieldNames())], TRAINING_RUNS), wh.ledger, TRAINING_RUNS)
    result["passed"] = tr.gate(result, threshold)
    result["model_path"] = None
    if result["passed"]:
        result["model_path"] = wh.model()
        tr.save_model(model, result["model_path"])
    publish_snapshot(spark, wh)
    return result

"""Structured Streaming twins of the batch jobs (STR-01..07).

The reference re-runs its jobs daily and keeps state in an id file and in NULL
scores. Here the file source's checkpoint is the high-water mark
(``trigger(availableNow=True)`` picks up exactly the files not yet committed),
and every sink is either a file sink or a ``foreachBatch`` writer that is safe
to replay:

* ids already seen are kept as keyed state in the RocksDB store (``dropDuplicates`` by id), so a
  batch costs what it holds, however many posts are stored; the first batch with an id wins, and
  in it the largest row. Rows without an id or a date are rejects;
* posts, counts and class-count deltas are committed as segments (``sources.segments``): a replayed
  batch is committed once, and segments are merged while the stream runs;
* updates by key are written under their batch id (a replay replaces its
  own folder) and read back last-write-wins per key;
* recomputed days replace their gold partitions through a staging folder, so a
  path is never read and overwritten by the same job.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from ..functions.labels import canonical_feedback
from ..operators import reputation as rep
from ..schemas import DAILY_REPUTATION, conform
from ..operators.ingest import one_per_key
from ..operators.quality import reject_reason
from ..operators.scoring import score_posts
from ..operators.updates import apply_feedback, apply_scores, last_write_per_key
from ..sources import segments as seg
from ..sources.tables import posts_from_events, restrict_to_days

POST_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("user_feedback", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("date", T.DateType()),
])


# ---- landing zone --------------------------------------------------------------------

def land_post_events(events: DataFrame, path: str, files_per_day: int = 1) -> None:
    """Posts with their event time, landed as parquet files partitioned by day.

    Rows are clustered by day (and up to ``files_per_day`` hash pieces of the id)
    with a ``rebalance`` hint: AQE merges small partitions and splits any
    partition above the advisory size, so a day holding a third of all posts is
    written by many tasks instead of one.
    """
    df = (posts_from_events(events, keep=("ts",)).withColumn("ts", F.col("ts").cast("timestamp"))
          .select(*POST_EVENT.fieldNames()))
    piece = F.pmod(F.xxhash64("id"), F.lit(files_per_day))
    (df.withColumn("_piece", piece).hint("rebalance", "date", "_piece").drop("_piece")
     .write.mode("overwrite").partitionBy("date").parquet(path))


def post_stream(spark: SparkSession, landing: str, max_files: int | None = None,
                schema: T.StructType = POST_EVENT) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(landing)


def run_available(writer, checkpoint: str) -> None:
    """Runs a stream over what has landed and is not committed yet, then ends."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _read_or_none(spark: SparkSession, path: str, schema: T.StructType | None = None):
    try:
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.parquet(path)
    except AnalysisException:
        return None


def _sort_key(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """A column to sort by; a list of texts as one text."""
    return pc.binary_join(column.cast(pa.list_(pa.string())), "\x00") if pa.types.is_list(column.type) else column


def _largest_per_id(batches):
    """Of the copies of an id in a partition the largest row, by the columns in order, NULL smallest."""
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        keys = pa.table({c: _sort_key(t.column(c)) for c in t.column_names})
        order = pc.sort_indices(keys, [("id", "ascending"), *((c, "descending") for c in t.column_names if c != "id")], null_placement="at_end")
        ids = t.column("id").combine_chunks().take(order).dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        yield from t.take(order.take(pa.array(first))).combine_chunks().to_batches()


def first_seen(posts: DataFrame) -> DataFrame:
    """STR-02: posts whose id no earlier batch had, and the rows that cannot be stored with their reason.

    The ids seen are keyed state of the stream; what a batch reads and writes of it are its own
    ids. Copies within a batch are reduced to one by a rule before they meet the state, so the answer does not
    depend on the order in which tasks finish.
    """
    usable = F.col("id").isNotNull() & F.col("date").isNotNull()
    one = posts.where(usable).repartition("id").mapInArrow(_largest_per_id, posts.schema)
    return (one.dropDuplicates(["id"]).withColumn("reject_reason", F.lit(None).cast("string"))
            .unionByName(posts.where(~usable).withColumn("reject_reason", reject_reason(posts))))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity of the state that a checkpoint holds; a new checkpoint has seen nothing."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def _new_posts(batch: DataFrame, stored: seg.Manifest, root: str, stream: str | None) -> DataFrame:
    """Rows of a batch to be stored. The state of ``stream`` has seen what that stream stored; rows that others stored
    (its checkpoint was lost, or there is none) are looked up by id."""
    foreign = [s for s in stored.live if stream is None or s.origin != stream]
    usable = batch.where(F.col("id").isNotNull() & F.col("date").isNotNull()).select(*POST_EVENT.fieldNames())
    if stream is None:
        usable = one_per_key(usable)
    if not foreign:
        return usable
    known = seg.read_segments(batch.sparkSession, root, foreign, POST_EVENT).select("id")
    return usable.join(known.distinct(), "id", "left_anti").select(*POST_EVENT.fieldNames())


REJECTS = T.StructType(POST_EVENT.fields + [T.StructField("reject_reason", T.StringType())])


def _reject(batch: DataFrame, sink: str, stream: str | None, batch_id: int) -> None:
    """Rows that cannot be stored, with their reason."""
    bad = batch.where(F.col("id").isNull() | F.col("date").isNull())
    bad = bad.drop("reject_reason").withColumn("reject_reason", reject_reason(bad))
    seg.append(bad, f"{sink}-rejects", REJECTS, stream, batch_id)


def read_posts(spark: SparkSession, sink: str) -> DataFrame:
    """What a stream of posts has stored."""
    return seg.read(spark, sink, POST_EVENT)


def read_rejects(spark: SparkSession, sink: str) -> DataFrame:
    return seg.read(spark, f"{sink}-rejects", REJECTS)


# ---- STR-01: incremental ingest ------------------------------------------------------------

def stream_ingest(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                  max_files: int | None = None) -> None:
    src = post_stream(spark, landing, max_files)
    run_available(src.writeStream.format("parquet").partitionBy("date").option("path", sink), checkpoint)


# ---- STR-02: drop posts already seen ----------------------------------------------------------

def dedup_writer(spark: SparkSession, sink: str, checkpoint: str | None = None):
    """``foreachBatch`` function: commits the posts not stored yet to ``sink`` and rows without id or date
    to ``<sink>-rejects``. A batch that is committed already adds nothing. Without a checkpoint there is no state,
    and the ids stored are read instead."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(spark, checkpoint) if checkpoint else None
        stored = seg.latest(spark, sink)
        batch = batch.persist()
        _reject(batch, sink, stream, batch_id)
        seg.append(_new_posts(batch, stored, sink, stream), sink, POST_EVENT, stream, batch_id, partition_by="date")
        batch.unpersist()

    return upsert


def stream_dedup(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                 max_files: int | None = None) -> None:
    run_available(first_seen(post_stream(spark, landing, max_files)).writeStream
         .foreachBatch(dedup_writer(spark, sink, checkpoint)), checkpoint)


def dedup_within_watermark(src: DataFrame, delay: str = "2 days") -> DataFrame:
    """STR-02, bounded-state variant: a repeat of an id arriving within ``delay`` of the
    first copy's event time is dropped; state older than the watermark is purged."""
    return src.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def stream_dedup_watermark(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                           delay: str = "2 days", max_files: int | None = None) -> None:
    out = dedup_within_watermark(post_stream(spark, landing, max_files), delay)
    run_available(out.writeStream.format("parquet").partitionBy("date").option("path", sink), checkpoint)


# ---- STR-03: tumbling day counts per class -----------------------------------------------------

COUNTS_LOG = T.StructType([T.StructField("day", T.DateType()), T.StructField("sentiment", T.StringType()),
                           T.StructField("count", T.LongType()), T.StructField("batch_id", T.LongType())])


def _last_counts(log: DataFrame) -> DataFrame:
    return (log.groupBy("day", "sentiment").agg(F.max(F.struct("batch_id", "count")).alias("v"))
            .select("day", "sentiment", "v.count", "v.batch_id"))


def stream_daily_counts(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                        max_files: int | None = None) -> None:
    """Update mode: each batch emits the running count of every touched (day, class).

    There is no watermark: a post counts for its day however late it comes. The state is
    one number for each day and class, so it grows with the calendar, not with posts. The log's segments are
    merged to the last count of each key.
    """
    counts = (post_stream(spark, landing, max_files)
              .groupBy(F.window("ts", "1 day"), "sentiment")
              .agg(F.count(F.lit(1)).alias("count")))

    def log(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.to_date(F.col("window.start")).alias("day"), "sentiment", "count", F.lit(batch_id).cast("long").alias("batch_id"))
        seg.append(rows, sink, COUNTS_LOG, stream_id(spark, checkpoint), batch_id, merge=_last_counts)

    run_available(counts.writeStream.outputMode("update").foreachBatch(log), checkpoint)


def latest_counts(spark: SparkSession, sink: str) -> DataFrame:
    return _last_counts(seg.read(spark, sink, COUNTS_LOG)).select(F.col("day").alias("date"), "sentiment", "count")


CLASS_COUNTS = ("positive_count", "negative_count", "neutral_count")
DELTAS = T.StructType([T.StructField("date", T.DateType()), *(T.StructField(c, T.LongType()) for c in CLASS_COUNTS)])


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("date").agg(*[F.sum(c).alias(c) for c in CLASS_COUNTS])


# ---- STR-04: late rows are added to their day ----------------------------------------------------

def stream_daily_reputation(spark: SparkSession, landing: str, silver: str, gold: str,
                            checkpoint: str, max_files: int | None = None,
                            weights=rep.DEFAULT_WEIGHTS) -> None:
    """Keep the new posts of each batch, and overwrite the gold partitions of the days it
    touched with the sum of the class counts of all batches.

    No row is dropped however late it is. A batch commits its new posts to ``silver`` and their class counts by
    day to ``<gold>-deltas``, whose segments are merged to sums; of what is stored it reads the
    counts of the touched days, however many posts a day has. A replay commits nothing anew and writes the
    same gold days again. The new days go to a fresh staging folder first, so gold is never
    read and overwritten by one job.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        stream, deltas = stream_id(spark, checkpoint), f"{gold}-deltas"
        batch = batch.persist()
        _reject(batch, silver, stream, batch_id)
        fresh = _new_posts(batch, seg.latest(spark, silver), silver, stream)  # the same in a replay: a stream's own segments do not count
        seg.append(fresh, silver, POST_EVENT, stream, batch_id, partition_by="date")
        seg.append(rep.class_counts(fresh), deltas, DELTAS, stream, batch_id, merge=_summed)
        total = _summed(restrict_to_days(seg.read(spark, deltas, DELTAS), batch))
        stage = f"{gold}-staging/{batch_id}-{uuid.uuid4().hex}"
        (conform(rep.with_index(total, weights), DAILY_REPUTATION)
         .write.mode("overwrite").partitionBy("date").parquet(stage))
        (spark.read.schema(DAILY_REPUTATION).parquet(stage)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(gold))
        batch.unpersist()

    run_available(first_seen(post_stream(spark, landing, max_files)).writeStream.foreachBatch(upsert), checkpoint)


def read_gold(spark: SparkSession, gold: str) -> DataFrame:
    return spark.read.schema(DAILY_REPUTATION).parquet(gold).select(*DAILY_REPUTATION.fieldNames())


# ---- STR-06: scores and feedback by key, in micro-batches -------------------------------------------

UPDATE_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("answer", T.StringType()),
])


def stream_upsert(spark: SparkSession, landing: str, log: str, checkpoint: str,
                  max_files: int | None = None) -> None:
    """Updates by key as they arrive: score rows have a ``sentiment``, feedback rows an
    ``answer``. A batch is reduced to its last write of each id and kind and kept in
    its own folder of ``log``, so a batch costs what it holds, whatever is stored, and a
    replay replaces what it wrote. ``upserted`` applies the log. Rows without id, with an
    answer that is not accepted (their score, if any, is still written) or with nothing to
    write go to ``<log>-rejects``, a folder for each batch."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        keyed = batch.where(F.col("id").isNotNull())
        scores = last_write_per_key(keyed.where(F.col("sentiment").isNotNull()), "id", "seq",
                                    ["seq", "sentiment", "confidence"])
        answers = last_write_per_key(_valid_answers(keyed), "id", "seq", ["seq", "answer"])
        (scores.unionByName(answers, allowMissingColumns=True)
         .write.mode("overwrite").parquet(f"{log}/batch={batch_id}"))
        (batch.withColumn("reject_reason", _update_reject_reason()).where(F.col("reject_reason").isNotNull())
         .write.mode("overwrite").parquet(f"{log}-rejects/batch={batch_id}"))
        batch.unpersist()

    run_available(post_stream(spark, landing, max_files, UPDATE_EVENT).writeStream.foreachBatch(upsert), checkpoint)


def _valid_answers(updates: DataFrame) -> DataFrame:
    """An answer outside the accepted ones is no write, so it must not hide an earlier one."""
    return updates.where(canonical_feedback(F.col("answer")).isNotNull())


def _update_reject_reason() -> F.Column:
    """FLT-10: why an update, or its answer, is not written (NULL = accepted)."""
    return (F.when(F.col("id").isNull(), F.lit("missing_id"))
            .when(F.col("answer").isNotNull() & canonical_feedback(F.col("answer")).isNull(), F.lit("bad_feedback"))
            .when(F.col("sentiment").isNull() & F.col("answer").isNull(), F.lit("missing_value")))


def upserted(spark: SparkSession, posts: DataFrame, log: str) -> DataFrame:
    """``posts`` with every streamed update applied, the last write of each id winning."""
    updates = _read_or_none(spark, log, UPDATE_EVENT)
    if updates is None:
        return posts
    scored = apply_scores(posts, updates.where(F.col("sentiment").isNotNull()))
    return apply_feedback(scored, updates.where(F.col("answer").isNotNull()))


# ---- STR-05: score new rows as they arrive ---------------------------------------------------------

def stream_score(spark: SparkSession, landing: str, schema: T.StructType, sink: str,
                 checkpoint: str, max_files: int | None = None) -> None:
    src = post_stream(spark, landing, max_files, schema)
    run_available(score_posts(src).writeStream.format("parquet").option("path", sink), checkpoint)


# ---- STR-07: closed days only (append mode) ------------------------------------------------------

def stream_closed_days(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                       watermark: str = "1 day", max_files: int | None = None,
                       weights=rep.DEFAULT_WEIGHTS) -> None:
    """A day is emitted once the watermark passes its end; open days never are."""
    s = F.col("sentiment")
    days = (post_stream(spark, landing, max_files)
            .withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day"))
            .agg(F.count_if(s == "positive").alias("positive_count"),
                 F.count_if(s == "negative").alias("negative_count"),
                 F.count_if(s == "neutral").alias("neutral_count")))
    out = days.select(
        F.to_date(F.col("window.start")).alias("date"),
        "positive_count", "negative_count", "neutral_count",
        rep.reputation_index(F.col("positive_count"), F.col("neutral_count"),
                             F.col("negative_count"), weights).alias("reputation_index"))
    run_available(out.writeStream.outputMode("append").format("parquet").option("path", sink), checkpoint)

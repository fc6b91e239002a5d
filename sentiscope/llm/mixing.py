"""Mixing sources to target weights.

A document's size is its number of words. Sources in code point order (null last) weigh
5, 2, 1, 5, 2, 1, ... and share ``share`` of all words by weight; a target stops at
``most`` times its source's size, and what is over is shared again by weight among the
others until none is above. A source's repetition rate is its target over its size, and
each document is taken floor(rate) times, plus once more with the fraction as the
probability. The draw is a hash of seed and doc_id, so reruns and retried tasks agree.

The resharing has a closed form: a source is at its stop exactly if, with the sources in
order of size over weight, what those before it leave would give it its stop or more. It is
computed in whole numbers on the table of sources, one row each; documents are only
read, never shuffled, as long as that table is small enough to broadcast, and joined
otherwise.

Defined cases: a null or empty text has size 0 and is taken 0 words; a source without
words has target 0; a null source is a source; a null doc_id draws by its text; equal
rows draw alike; an empty table gives an empty one. In the plan ``size``, ``source_size``,
``target``, ``copies`` and ``taken`` replace columns of these names, in the mix ``copy`` does; all others
come through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentiscope.llm.common import table, whole_row
from sentiscope.session import scratch_path

WEIGHTS = (5, 2, 1)
#: Share of all words and stop of a target, in hundredths of the size.
SHARE, MOST = 150, 200
SEED = 20240229
#: Sources up to which their table is broadcast (a name, three numbers: under 20 MB).
BROADCAST_ROWS = 100_000
#: Places that the rows of a source are spread over where that table is joined.
PLACES = 32
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int = SEED) -> Column:
    """A number in [0, 1) with 52 bits from the hash of seed and id."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2 ** 52))


def source_targets(docs: DataFrame, weights=WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    sizes = docs.groupBy("source").agg(F.sum(n_words()).alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long")
    s = sizes.withColumn("weight", weight)
    every = Window.partitionBy()
    # size / weight in order: products of whole numbers would need a comparison of pairs, the quotient a tie-break
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("total", F.sum(whole("source_size")).over(every))
         .withColumn("weights", F.sum(whole("weight")).over(every))
         .withColumn("size_before", F.coalesce(F.sum(whole("source_size")).over(before), F.lit(0).cast("decimal(38,0)")))
         .withColumn("weight_before", F.coalesce(F.sum(whole("weight")).over(before), F.lit(0).cast("decimal(38,0)"))))
    left = share * F.col("total") - most * F.col("size_before")  # in hundredths of a word
    stopped = F.col("weight") * left >= most * F.col("source_size") * (F.col("weights") - F.col("weight_before"))
    s = s.withColumn("stopped", stopped)
    open_left = share * F.col("total") - most * F.coalesce(F.sum(F.when(F.col("stopped"), whole("source_size"))).over(every), F.lit(0).cast("decimal(38,0)"))
    open_weight = F.sum(F.when(~F.col("stopped"), whole("weight"))).over(every)
    target = F.when(F.col("stopped"), (most * F.col("source_size")).cast("double") / 100.0).otherwise(
        (F.col("weight") * open_left).cast("double") / (100 * open_weight).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _rated(docs: DataFrame, seed: int, shares: dict) -> DataFrame:
    """``row`` (the caller's columns, whatever their names), ``size``, ``source_size``, ``target`` and ``copies``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "mix-targets")
    source_targets(docs, **shares).withColumnRenamed("source", "of").write.parquet(path)
    targets = spark.read.parquet(path)
    here = docs.select(whole_row(docs).alias("row"), F.col("source").alias("key"), n_words().alias("size"), draw(seed).alias("u"))
    same = F.col("key").eqNullSafe(F.col("of"))
    if targets.count() <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    else:  # texts are shuffled: a source's rows go to several places, the targets to all of them
        here = here.withColumn("place", F.pmod(F.xxhash64("u", "size"), F.lit(PLACES)))
        targets = targets.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
        same = same & (F.col("place") == F.col("at"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = here.join(targets, same).withColumn("rate", rate)
    copies = F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("long")
    return rated.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix_plan(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    made = ("size", "source_size", "target", "copies", "taken")
    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return _rated(docs, seed, shares).select(*rest, *made[:4], (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """The mix itself: each row as often as it is taken, numbered by ``copy`` from 1 on."""
    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "copy"]
    return (_rated(docs, seed, shares).where("copies > 0")
            .select(*rest, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13))::BIGINT
           / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS HUGEINT) AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, CAST(sum(source_size) OVER () AS HUGEINT) AS total, CAST(sum(weight) OVER () AS HUGEINT) AS weights,
         CAST(coalesce(sum(source_size) OVER b, 0) AS HUGEINT) AS size_before,
         CAST(coalesce(sum(weight) OVER b, 0) AS HUGEINT) AS weight_before
  FROM s WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT *, weight * (150 * total - 200 * size_before) >= 200 * source_size * (weights - weight_before) AS stopped FROM o),
t AS (
  SELECT source, source_size, CASE WHEN stopped THEN CAST(200 * source_size AS DOUBLE) / 100.0
    ELSE CAST(weight * (150 * total - 200 * CAST(coalesce(sum(CASE WHEN stopped THEN source_size END) OVER (), 0) AS HUGEINT)) AS DOUBLE)
         / CAST(100 * CAST(sum(CASE WHEN NOT stopped THEN weight END) OVER () AS HUGEINT) AS DOUBLE) END AS target
  FROM c),
r AS (
  SELECT d.doc_id, d.size, d.u, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""

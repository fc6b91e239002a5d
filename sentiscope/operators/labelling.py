"""Training labels, the exact seeded split and split profiles (ML-01..03, AGG-11..13, AGG-19).

Exact split by radix selection: rows have a place in the order of ``md5(key || seed)`` (copies of
a key: of a hash of the whole row), but they are never sorted. The two cuts, after the test
share and after the validation share, are found from counts: rows are counted by the first digits
of their hash, and only the bucket that holds a cut is counted again by the next
digits, until a cut lies between two buckets. Then one comparison with the cuts gives each row its
split where it lies: no exchange of rows, no checkpoint. If a cut falls into rows that are equal in
every column, so many of them as the cut asks for go to its left; which ones cannot be told apart. The
stratified variant (D21) selects the cuts of all classes at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.labels import canonical_label, label_source
from ..session import scratch_path

SPLITS = ("train", "validation", "test")


def training_labels(posts: DataFrame, source: str = "feedback_first",
                    keep_cols=("id",)) -> DataFrame:
    """ML-03: scored rows -> canonical label; unknown spellings are dropped (D12)."""
    lab = canonical_label(label_source(F.col("sentiment"), F.col("user_feedback"), source))
    return (posts.where(F.col("sentiment").isNotNull())
            .select(*keep_cols, lab.alias("label"))
            .where(F.col("label").isNotNull()))


#: Hexadecimal digits that one count tells apart, and those of the key's and the row's hash.
DIGITS, KEY_DIGITS, ROW_DIGITS = 4, 32, 16
#: Copies of one row that are made in one place.
CHUNK = 100_000


def _place(df: DataFrame, key: str, seed: int, digits: int) -> F.Column:
    """ML-01: a row's place in the seeded order as hexadecimal text; only as much of it as is asked for."""
    h = F.md5(F.coalesce(F.concat(F.col(key).cast("string"), F.lit(str(seed))), F.lit("")))
    if digits <= KEY_DIGITS:
        return F.substring(h, 1, digits)
    return F.substring(F.concat(h, F.lower(F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), ROW_DIGITS, "0"))), 1, digits)


def _held(counted: DataFrame, by: list[str]) -> DataFrame:
    """The buckets (``p``, ``c`` rows) in which the targets lie: ``below`` rows come before the bucket."""
    group = Window.partitionBy(*by, "which")  # at most 16 ** DIGITS rows
    cum = F.col("start") + F.sum("c").over(group.orderBy("p"))
    return (counted.withColumn("cum", cum).where("target BETWEEN cum - c + 1 AND cum")
            .select(*by, "which", "target", "p", (F.col("cum") - F.col("c")).alias("below"), "c"))


def split_cuts(df: DataFrame, key: str = "id", seed: int = 42, test_share: float = 0.2, val_share: float = 0.1,
               by: tuple[str, ...] = ()) -> DataFrame:
    """ML-02: for each group of ``by`` the cuts 0 (test) and 1 (validation): rows whose place begins with ``p`` or less
    come before it, ``target`` of them, and of the ``c`` rows that begin with ``p`` only ``target - below`` do."""
    spark = df.sparkSession
    groups = [f"_by{n}" for n in range(len(by))]
    own = [F.col(b).alias(g) for b, g in zip(by, groups)]

    def kept(cuts: DataFrame) -> DataFrame:
        path = scratch_path(spark, "split-cuts")
        cuts.write.parquet(path)
        return spark.read.parquet(path)

    counted = df.groupBy(*own, _place(df, key, seed, DIGITS).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(Window.partitionBy(*groups)).cast("double")
    t = F.ceil(F.lit(float(test_share)) * n)
    v = F.ceil(F.lit(float(val_share)) * (n - t))
    counted = (counted.withColumn("t", t).withColumn("v", v)
               .select("*", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("t").alias("target")),
                                              F.struct(F.lit(1).alias("which"), (F.col("t") + F.col("v")).alias("target")))).alias("cut"))
               .select(*groups, "p", "c", "cut.which", "cut.target", F.lit(0).cast("long").alias("start")))
    cuts = kept(_held(counted, groups))
    done, digits = [], DIGITS
    while True:
        inside = (F.col("below") + F.col("c") != F.col("target")) & (digits < KEY_DIGITS + ROW_DIGITS)
        done.append(cuts.where(~inside))
        open_ = cuts.where(inside)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        digits += DIGITS
        x = df.select(*own, _place(df, key, seed, digits).alias("x"))
        o = open_.select(*[F.col(g).alias(f"_o{n}") for n, g in enumerate(groups)], "which", "target", F.col("p").alias("prefix"), F.col("below").alias("start"))
        on = F.substring("x", 1, digits - DIGITS) == F.col("prefix")
        for n, g in enumerate(groups):
            on = on & F.col(g).eqNullSafe(F.col(f"_o{n}"))
        counted = x.join(o, on).groupBy(*groups, "which", "target", "start", F.col("x").alias("p")).agg(F.count(F.lit(1)).alias("c"))
        cuts = kept(_held(counted, groups))


def train_val_test_split(labelled: DataFrame, key: str = "id", seed: int = 42,
                         test_share: float = 0.2, val_share: float = 0.1,
                         stratify_by: str | None = None) -> DataFrame:
    """ML-02: test = first ceil(test_share*n) rows in the seeded order, validation = next ceil(val_share*(n-test)); random by
    default (D21). With ``stratify_by`` the same exact cut is made inside every class, so each split keeps the class shares."""
    by = (stratify_by,) if stratify_by else ()
    cuts = split_cuts(labelled, key, seed, test_share, val_share, by)
    whole = KEY_DIGITS + ROW_DIGITS
    wide = cuts.groupBy(*[F.col(f"_by{n}") for n in range(len(by))]).agg(
        *[F.max(F.when(F.col("which") == w, F.col(c))).alias(f"_{c}{w}") for w in (0, 1) for c in ("p", "below", "target")],
        F.max(F.when((F.length("p") == whole) & (F.col("below") + F.col("c") != F.col("target")), F.col("p"))).alias("_equal"),
        F.max(F.length("p")).alias("_digits"))
    path = scratch_path(labelled.sparkSession, "split-groups")
    wide.write.parquet(path)
    wide = labelled.sparkSession.read.parquet(path)
    digits, equal = wide.agg(F.max("_digits"), F.max("_equal")).first()
    if digits is None:
        return labelled.withColumn("split", F.lit("train"))  # no row, or no share
    names = [f"_{c}{w}" for w in (0, 1) for c in ("p", "below", "target")] + ["_equal"]
    x = labelled.withColumn("_x", _place(labelled, key, seed, digits))
    if by:
        x = x.join(wide.drop("_digits"), F.col(by[0]).eqNullSafe(F.col("_by0")), "left")
    else:  # one row: constants of the plan
        row = wide.first()
        x = x.select("*", *[F.lit(row[n]).cast(wide.schema[n].dataType).alias(n) for n in names])
    before = lambda w: F.coalesce(F.substring("_x", F.lit(1), F.length(f"_p{w}")) <= F.col(f"_p{w}"), F.lit(False))
    name = lambda first, second: F.when(first, "test").when(second, "validation").otherwise("train").alias("split")
    if equal is None:
        return x.select(*labelled.columns, name(before(0), before(1)))
    cut = F.coalesce(F.col("_x") == F.col("_equal"), F.lit(False)) | F.coalesce(F.col("_x") == F.col("_p0"), F.lit(False))
    same = x.where(cut).groupBy(*[F.col(f"`{c}`") for c in labelled.columns], "_x", *names).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy("_x").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in labelled.columns])))  # rows of one hash: as good as one
    same = same.withColumn("_at", F.sum("_c").over(order) - F.col("_c"))
    made = (same.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / CHUNK))))
            .repartition("_x", "_k").withColumn("_i", F.explode(F.sequence(F.col("_k") * CHUNK + 1, F.least("_c", (F.col("_k") + 1) * CHUNK)))))
    left = lambda w: F.when(F.col("_x") == F.col(f"_p{w}"), F.col(f"_below{w}") + F.col("_at") + F.col("_i") <= F.col(f"_target{w}")).otherwise(before(w))
    return (x.where(~cut).select(*labelled.columns, name(before(0), before(1)))
            .unionByName(made.select(*labelled.columns, name(left(0), left(1)))))


def split_sizes(split: DataFrame) -> DataFrame:
    """AGG-13: rows per split and the grand total (split NULL)."""
    per = split.groupBy("split").agg(F.count(F.lit(1)).alias("c"))  # a few rows a task; only these are rolled up
    return per.rollup("split").agg(F.sum("c").alias("n"))


def split_class_counts(split: DataFrame) -> DataFrame:
    """AGG-11."""
    return split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def distribution_matrix(split: DataFrame) -> DataFrame:
    """AGG-12: class x split with row and column totals (cube, then pivot on split)."""
    per = split.groupBy("label", "split").agg(F.count(F.lit(1)).alias("c"))
    c = per.cube("label", "split").agg(F.sum("c").alias("n"), F.grouping_id().alias("g"))
    cells = c.select(
        F.when(F.col("g").bitwiseAND(2) == 0, F.col("label")).alias("label"),
        F.when(F.col("g").bitwiseAND(1) == 0, F.col("split")).otherwise(F.lit("total")).alias("col"),
        "n")
    wide = cells.groupBy("label").pivot("col", list(SPLITS) + ["total"]).agg(F.sum("n"))
    return wide.select("label", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s)
                                  for s in list(SPLITS) + ["total"]])


def class_balance(labelled: DataFrame) -> DataFrame:
    """AGG-19: distinct classes, smallest and largest class, largest/smallest."""
    per = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("classes"),
                   F.min("c").alias("min_class"),
                   F.max("c").alias("max_class"),
                   F.round(F.max("c") / F.min("c"), 6).alias("imbalance_ratio"))

"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of text that one unit of Python work holds, about.
UNIT_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one number, from a pass that shuffles one row a task."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def units(total: int, least: int, size: int = UNIT_BYTES) -> int:
    """How many units of about ``size`` bytes the work is cut into; grows with the input."""
    return max(least, math.ceil(total / size))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row. A lambda that refers to a column
    computes it again for each element once the optimizer has put the column's expression
    in its place (a filter on the result is enough); a lambda's own variable stays one."""
    return F.get(F.transform(F.array(value), body), 0)


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, so that columns made beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def id_text(column: str = "doc_id") -> Column:
    """An id as decimal text (null: empty), as the crc32 folds take it."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return (F.crc32(id_text(column)) % n).cast("int")

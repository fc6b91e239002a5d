"""Historic CSV ``author,author account,date,text`` (SRC-03).

Two readers:

* ``read_history_csv_strict``: Spark's CSV reader with ``multiLine`` for clean,
  RFC-quoted files.
* ``read_history_csv``: tolerant reader for hand-edited files with unclosed or
  stray quotes. A record's last field is, in this order: a well-formed quoted
  field (it may hold line breaks and anything that looks like a record), the rest of the
  line, and, where a quote is never closed, everything up to the next line that starts like
  a record (a name, a field with ``@``, a short field). A line that is no record at all
  becomes a row with its text alone. So every line of a file is in some row, whatever
  its date looks like; rows without a usable date are rejected later, with a reason.
  A file is read by as many tasks as it has splits (``csv_ranges``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .csv_ranges import records

HEADER = "author,author account,date,text"
_QUOTED = r'"(?:[^"]++|"")*+"'
_FIELD = rf'(?:{_QUOTED}|[^",\r\n]*+)'
FIELDS = rf'^({_FIELD}),({_FIELD}),({_FIELD}),((?s:.*))$'

CSV_SCHEMA = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("author account", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("text", T.StringType()),
])


def _unquote(c: F.Column) -> F.Column:
    """A quoted field loses its outer quotes (the closing one may be missing) and doubled
    quotes become one; an unquoted field is kept as it is (a stray quote stays)."""
    inner = F.regexp_replace(c, r'(?s)^"(.*?)"?$', "$1")
    return F.when(c.startswith('"'), F.regexp_replace(inner, '""', '"')).otherwise(c)


def read_history_csv(spark: SparkSession, path: str) -> DataFrame:
    recs = records(spark, path)
    recs = recs.where((F.trim("rec") != HEADER) & (F.length(F.trim("rec")) > 0))
    whole = F.col("rec").rlike(FIELDS)
    out = []
    for i, name in enumerate(CSV_SCHEMA.fieldNames(), start=1):
        v = F.when(whole, _unquote(F.regexp_extract("rec", FIELDS, i)))
        out.append((v.otherwise(F.col("rec")) if name == "text" else v).alias(name))
    return recs.select(*out)


def read_history_csv_strict(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(CSV_SCHEMA).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_history_csv(df: DataFrame, path: str) -> None:
    """RFC quoting (doubled quotes), values kept byte for byte."""
    (df.select(*CSV_SCHEMA.fieldNames()).write.mode("overwrite")
     .option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))

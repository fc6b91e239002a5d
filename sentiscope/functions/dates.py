"""Date and time parsing (SCL-03/13/14, CLN-01)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings of a day in landed or historic data, tried in order.
DAY_PATTERNS = ("yyyy-MM-dd", "dd/MM/yyyy")
LEDGER_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def clean_date(raw: Column) -> Column:
    """CLN-01: trimmed text in any accepted spelling -> DATE, NULL when none fits."""
    t = F.trim(raw)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)).cast("date") for p in DAY_PATTERNS])


def iso_to_day(iso: Column) -> Column:
    """SCL-03: ISO-8601 time stamp text (e.g. ``2024-01-05T10:00:00.000Z``) -> day (UTC)."""
    return F.to_date(F.try_to_timestamp(iso))


def ledger_time(ts: Column) -> Column:
    """SCL-13: time stamp as the ledger's text form."""
    return F.date_format(ts, LEDGER_TIME_FORMAT)

"""Threshold bands of the monitoring panels (SCL-15/16) as CASE ladders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Panel thresholds (lower bound of each band, ascending) and band names.
POST_COUNT_STEPS = ((0, "red"), (100, "blue"), (200, "green"), (500, "#6ED0E0"))
ACCURACY_STEPS = ((0.0, "green"), (0.5, "red"), (0.7, "orange"), (0.8, "yellow"), (0.9, "green"))
DAILY_INDEX_STEPS = ((0.0, "#EAB839"), (1.0, "green"))
INDEX_PERCENT_STEPS = ((0.0, "red"), (30.0, "orange"), (60.0, "green"))
CONFIDENCE_PERCENT_STEPS = ((0.0, "red"), (50.0, "#EAB839"), (70.0, "orange"), (80.0, "blue"), (90.0, "green"))
# Index range used to turn a mean index into a percentage: lowest possible index
# (all negative, -w_neg) to the panel maximum 2.
INDEX_MIN, INDEX_MAX = -3.0, 2.0


def band(value: Column, steps, below: str = "red") -> Column:
    """Name of the highest step whose lower bound is <= value; ``below`` under the first one."""
    expr = F.lit(below)
    for lo, name in steps:
        expr = F.when(value >= F.lit(lo), F.lit(name)).otherwise(expr)
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(expr)


def percent_of_range(value: Column, lo: float, hi: float) -> Column:
    return (value - F.lit(lo)) / F.lit(hi - lo) * F.lit(100.0)

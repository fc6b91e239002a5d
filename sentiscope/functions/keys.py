"""PRJ-08: deterministic surrogate keys of exactly ``h`` digits.

The reference draws random numbers; a rerun would give new ids. Here the key
is a hash of the natural key, so reruns and retried tasks give the same id.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits_key(natural: Column, h: int, salt: str = "") -> Column:
    if h <= 0 or h > 18:
        raise ValueError("key length must be in 1..18 digits")
    lo = 10 ** (h - 1)
    span = 9 * lo
    # 60 bits of the md5 as a non-negative BIGINT.
    hv = F.conv(F.substring(F.md5(F.concat(F.lit(salt), natural.cast("string"))), 1, 15), 16, 10).cast("bigint")
    return (F.lit(lo) + F.pmod(hv, F.lit(span))).cast("bigint")


def history_text(key: Column) -> Column:
    """The reference's one-element id list kept as text: ``['123']``."""
    return F.concat(F.lit("['"), key.cast("string"), F.lit("']"))

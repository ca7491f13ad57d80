"""Scalar expressions whose exact semantics differ between engines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b) -> Column:
    """Quotient rounded down, also for negative numbers (SQL's ``div`` rounds towards zero)."""
    return F.floor(a / b).cast("long")


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounding to even on ties."""
    return F.bround(c, digits)


def finite(c: Column) -> Column:
    """NaN and infinities as null, so that missing never counts as a number."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def iso_week(ts: str) -> Column:
    """ISO year and week as ``YYYY-Www``."""
    return F.concat(F.expr(f"extract(YEAROFWEEK FROM {ts})"), F.lit("-W"), F.lpad(F.expr(f"extract(WEEK FROM {ts})").cast("string"), 2, "0"))


def normal_p(z: float) -> float:
    """Two-sided normal tail of one statistic (driver side, for tables of estimates)."""
    return math.erfc(abs(z) / math.sqrt(2))


def text_hash(*cols: Column | str, seed: str = "") -> Column:
    """A number of 60 bits from the MD5 of the values as text joined by ``|`` (nulls as ``~``), which any engine can repeat."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("~")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")

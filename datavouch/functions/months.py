"""Months as text AAAAMM, by integer arithmetic (no dates, so bad text is null and never an error)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"\A[0-9]{4}(0[1-9]|1[0-2])\z"


def valid_month(c: Column) -> Column:
    return F.coalesce(c.rlike(PATTERN), F.lit(False))


def month_index(c: Column) -> Column:
    """Months since year 0; null for text that isn't a month."""
    return F.when(valid_month(c), F.substring(c, 1, 4).try_cast("long") * 12 + F.substring(c, 5, 2).try_cast("long") - 1)


def month_text(i: Column) -> Column:
    return F.concat(F.lpad(F.floor(i / 12).cast("string"), 4, "0"), F.lpad((F.pmod(i, F.lit(12)) + 1).cast("string"), 2, "0"))


def month_shift(c: Column, n: int | Column) -> Column:
    """The month ``n`` months later."""
    return month_text(month_index(c) + n)


def month_diff(a: Column, b: Column) -> Column:
    """Months from ``b`` to ``a``."""
    return month_index(a) - month_index(b)

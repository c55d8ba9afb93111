"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 0) -> Column:
    """x rounded half up to so many decimals; a whole number for 0 places."""
    if places == 0:
        return F.floor(x + F.lit(0.5))
    scale = 10**places
    return F.floor(x * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def percent(part: Column, whole: Column) -> Column:
    """part of whole in per cent, a whole number; null where whole is 0."""
    return F.when(whole > 0, rounded(part / whole * 100))


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))

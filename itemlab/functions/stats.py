"""Statistics that are exact in the same way in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on a decimal, so that doubles a hair beside a tie round alike everywhere."""
    scale = 8 if digits >= 4 else 6
    return F.round(x.cast(f"decimal(18,{scale})"), digits).cast("double")


def pearson(x: Column, y: Column, least: int, epsilon: float) -> Column:
    """Aggregate: correlation from moments; 0 with under ``least`` pairs or a denominator up to epsilon."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    covariance = F.sum(x * y) - F.sum(x) * F.sum(y) / n
    of_x = F.greatest(F.sum(x * x) - F.sum(x) * F.sum(x) / n, F.lit(0.0))
    of_y = F.greatest(F.sum(y * y) - F.sum(y) * F.sum(y) / n, F.lit(0.0))
    bottom = F.sqrt(of_x * of_y)
    return F.when((n < least) | (bottom <= epsilon) | bottom.isNull(), 0.0).otherwise(covariance / bottom)


def alpha(k: Column, mean_r: Column) -> Column:
    """Standardised reliability of k items with a mean correlation, between 0 and 1."""
    value = F.try_divide(k * mean_r, 1 + (k - 1) * mean_r)
    return F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def percent_change(now: Column, before: Column, digits: int = 1) -> tuple[Column, Column]:
    """Absolute change in percent of before, rounded to so many digits, and whether it isn't a decrease; 0 and true without a before."""
    none = before.isNull() | (before == 0)
    change = F.when(none, 0.0).otherwise(rounded(F.abs(now - before) / F.when(~none, before) * 100, digits))
    return change, F.coalesce(none | (now >= before), F.lit(True))

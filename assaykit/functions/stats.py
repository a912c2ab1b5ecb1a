"""Small statistics over aggregate rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(hits: Column, total: Column) -> Column:
    """hits / total as double, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(hits.cast("double"), total.cast("double")), F.lit(0.0))


def proportion_interval(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Normal-approximation interval for a proportion, clamped to [0, 1]; (0, 0) when n = 0."""
    margin = F.lit(z) * F.sqrt(F.try_divide(p * (F.lit(1.0) - p), n.cast("double")))
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), p - margin))
    high = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), p + margin))
    return low, high


def relative_drop(before: Column, after: Column) -> Column:
    """(before - after) / before, 0 when before is 0."""
    return F.when(before > 0, F.try_divide(before - after, before)).otherwise(0.0)

"""Small per-group regressions from exact integer sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slope_from_sums(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
    """Least-squares slope; null when the abscissa does not vary."""
    den = n * sxx - sx * sx
    return F.when(den != 0, (n * sxy - sx * sy).cast("double") / den)


def slope(x: Column, y: Column) -> Column:
    """Aggregate expression for the slope of integer ``y`` on integer ``x``."""
    x, y = x.cast("bigint"), y.cast("bigint")
    return slope_from_sums(F.count(F.lit(1)), F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x))

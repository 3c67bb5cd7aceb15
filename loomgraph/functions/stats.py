"""Statistics with defined results for degenerate groups: null, never NaN or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regression_slope(x: Column, y: Column) -> Column:
    """Least-squares slope; null for fewer than two points or a determinant below 1e-12."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x).cast("double")
    det = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    return F.when((n < 2) | (F.abs(det) < 1e-12), F.lit(None).cast("double")).otherwise(F.try_divide(n * F.sum(x * y) - F.sum(x) * F.sum(y), det))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null for fewer than three points or a variance of zero."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) < 3) | (F.var_pop(x) == 0) | (F.var_pop(y) == 0), F.lit(None).cast("double")).otherwise(F.try_divide(F.covar_pop(x, y), spread))

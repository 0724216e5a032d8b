"""Aggregates that stay defined where the built-in ones fail or take no window frame."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation over rows where both are known; null where either is constant (the built-in one raises there)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def framed_correlation(x: Column | str, y: Column | str, frame: WindowSpec) -> Column:
    """Pearson's correlation over a sliding frame's rows where both are known; null where either is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b).over(frame) / F.nullif(F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame), F.lit(0.0))


def exact_mean(x: Column | str, digits: int = 4) -> Column:
    """The mean of values with `digits` decimals, from a sum of integers, so that it doesn't depend on their order."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(F.round(x * 10**digits).cast("long")) / F.count(x) / 10**digits


def nearest_mean(x: Column | str, digits: int = 4) -> Column:
    """exact_mean by a single division, which makes it the double nearest to the true mean: one that ends in a half is rounded as such."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(F.round(x * 10**digits).cast("long")) / (F.count(x) * 10**digits)


def framed_median(x: Column | str, frame: WindowSpec) -> Column:
    """The median of a sliding frame's values; null for an empty frame."""
    values = F.sort_array(F.collect_list(x).over(frame))
    n = F.size(values)
    at = lambda k: F.get(values, k)
    return F.when(n > 0, (at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2)

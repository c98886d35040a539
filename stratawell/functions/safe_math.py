"""Numeric expressions with one policy for missing, zero and constant input.

Missing is NULL; NaN is turned to NULL on entry.  Nothing here raises under ANSI
mode: what has no value is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean(x: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(x), x)


def safe_log2(x: Column) -> Column:
    """log2 with -Infinity at 0 and NULL below."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x > 0, F.log2(x))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side or fewer than two pairs."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return F.when(F.count(F.when(both, 1)) >= 2, F.try_divide(F.covar_samp(a, b), spread))


def pairs(x: Column, y: Column) -> Column:
    """The number of complete pairs."""
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def partial(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """First-order partial correlation from three plain ones; NULL where a control explains a side fully."""
    rest = (1 - rxz * rxz) * (1 - ryz * ryz)
    return F.when(rest > 1e-18, F.try_divide(rxy - rxz * ryz, F.sqrt(rest)))


def padded_dispersion(x: Column, n_total: Column) -> Column:
    """sqrt(sum (x - mean)^2 / (n_total - 1)): deviations skip missing values, the divisor counts all places."""
    return F.sqrt(F.try_divide(F.var_pop(x) * F.count(x), n_total - 1))


def round_even(x: Column, digits: int = 0) -> Column:
    """Rounding with ties to the even digit."""
    return F.bround(x, digits)

"""Statistics that are plain column arithmetic or aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import FLOOR, t_quantile, t_two_sided_p

#: Fixed value: the normal quantile of the 95% interval.
Z95 = 1.959963984540054


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL, not zero, over an empty denominator."""
    return F.when(denominator > 0, numerator / denominator)


def undefined_reason(denominator: Column, name: str) -> Column:
    return F.when(denominator == 0, F.lit(f"{name} is zero"))


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """The 95% Wilson interval of a share, to six digits; NULL for no trials."""
    n, p, z2 = total.cast("double"), hits / total, Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(total > 0, F.round(low, 6)), F.when(total > 0, F.round(high, 6))


#: Decimals up to which averages are exact, and the whole numbers that a double holds.
AVG_DECIMALS, WHOLE = 6, 2.0**53


def steady_avg(value: Column) -> Column:
    """An aggregate: the average of doubles, the same in any order of the rows, and equal for equal averages. Values of up to
    AVG_DECIMALS decimals are added up as whole numbers while these stay under WHOLE (a sum of 9e9); others by ``avg``."""
    step = 10.0**AVG_DECIMALS
    units = F.rint(value * step)
    whole = (F.count_if(units / step != value) == 0) & (F.sum(F.abs(units)) < WHOLE)
    return F.when(whole, F.sum(units) / F.count(value) / step).otherwise(F.avg(value))


def log2_change(before: Column, after: Column) -> Column:
    """log2(after / before) by log1p, which keeps small changes; NULL unless both are positive."""
    return F.when((before > 0) & (after > 0), F.log1p((after - before) / before) / math.log(2))


def paired_t(n: Column, mean: Column, sd: Column) -> Column:
    return mean / (sd / F.sqrt(n.cast("double")))


def paired_t_p(n: Column, mean: Column, sd: Column, floor: float = FLOOR) -> Column:
    """Two-sided p of a paired t test. Under two pairs: 1. Without spread: 1 for a zero mean, else the floor."""
    flat = F.when(F.abs(mean) < 1e-15, F.lit(1.0)).otherwise(F.lit(floor))
    # the kernel sees NULL where it isn't used
    t = F.when((n >= 2) & (sd > 0), paired_t(n, mean, sd))
    p = t_two_sided_p(t, n - 1)
    return F.when(n < 2, F.lit(1.0)).when(sd <= 0, flat).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(floor), p)))


def paired_ci(effect: Column, p: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """A confidence interval from effect, p and n alone: the standard error follows from the t that has this p."""
    df = n - 1
    usable = (n >= 2) & (p > 0) & (p < 1) & (effect != 0)
    se = F.abs(effect) / t_quantile(F.when(usable, p), F.when(usable, df))
    half = se * t_quantile(F.when(usable, F.lit(1 - level)), F.when(usable, df))
    return effect - half, effect + half


def neg_log10(p: Column, floor: float = FLOOR) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def quartiles(x: Column) -> Column:
    """An aggregate: first quartile, median and third quartile, linear between ranks."""
    return F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def pearson(x: Column, y: Column) -> Column:
    """An aggregate: correlation, 0 where it is undefined."""
    r = F.corr(x, y)
    return F.coalesce(F.when(F.isnan(r), F.lit(0.0)).otherwise(r), F.lit(0.0))


def published(x: Column, digits: int = 10) -> Column:
    """A number as it is published: rounded, without negative zero, non-finite values as NULL."""
    r = F.round(x, digits) + F.lit(0.0)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(r)

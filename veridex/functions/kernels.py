"""Statistical kernels that Spark lacks, as Arrow-batched functions over columns of aggregated groups.

They run on one row per group, never on raw rows. Inputs that are NULL or out of range give NULL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tails import fisher_right_tail, sign_two_sided

FLOOR = 1e-300
#: Members of a group up to which rank tests count orderings exactly.
MAX_EXACT = 25
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _lg(x):
    return _lgamma(np.asarray(x, float)).astype(float)


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta by a continued fraction, all elements at once; NaN outside its domain."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)], out[ok & (x == 1)] = 0.0, 1.0
    on = ok & (x > 0) & (x < 1)
    if not on.any():
        return out
    a, b, x = a[on], b[on], x[on]
    swap = x >= (a + 1) / (a + b + 2)  # the fraction converges fast below the mean; the other side is its mirror
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / guard(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 301):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 3e-14):
            break
    front = np.exp(_lg(p + q) - _lg(p) - _lg(q) + p * np.log(z) + q * np.log1p(-z))
    value = front * h / p
    out[on] = np.clip(np.where(swap, 1 - value, value), 0, 1)
    return out


def gammainc_q(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 1.0
    low = ok & (x > 0) & (x < a + 1)
    if low.any():
        s, z = a[low], x[low]
        term = total = 1 / s
        for n in range(1, 2000):
            term = term * z / (s + n)
            total = total + term
            if np.all(term < total * 1e-16):
                break
        out[low] = 1 - total * np.exp(s * np.log(z) - z - _lg(s))
    high = ok & (x >= a + 1)
    if high.any():
        s, z = a[high], x[high]
        b = z + 1 - s
        c, d = np.full_like(z, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - s)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 3e-15):
                break
        out[high] = h * np.exp(s * np.log(z) - z - _lg(s))
    return np.clip(out, 0, 1)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_upper(t, df) -> np.ndarray:
    half = t_two_sided(t, df) / 2
    return np.where(np.asarray(t, float) >= 0, half, 1 - half)


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def gammainc_p(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma; by its own series where it is small, so it keeps its digits there."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.array(1 - gammainc_q(a, x))
    low = np.asarray((a > 0) & (x > 0) & (x < a + 1))
    if low.any():
        s, z = a[low], x[low]
        term = total = 1 / s
        for n in range(1, 2000):
            term = term * z / (s + n)
            total = total + term
            if np.all(term < total * 1e-16):
                break
        out[low] = total * np.exp(s * np.log(z) - z - _lg(s))
    return out


def chi2_lower(x, df) -> np.ndarray:
    return gammainc_p(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def chi2_upper(x, df) -> np.ndarray:
    return gammainc_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_upper(z) -> np.ndarray:
    return np.frompyfunc(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), 1, 1)(np.asarray(z, float)).astype(float)


def bisect(tail, p: np.ndarray, low: float, limit: float = 1e12, steps: int = 200) -> np.ndarray:
    """Where a falling tail function equals p: bracket by doubling up to ``limit``, then a fixed number of halvings."""
    p = np.asarray(p, float)
    a, b = np.full(p.shape, low), np.full(p.shape, 1.0)
    for _ in range(60):
        more = (tail(b) > p) & (b < limit)
        if not more.any():
            break
        b = np.where(more, b * 2, b)
    if (tail(np.minimum(b, limit)) > p).any():
        raise ValueError("quantile lies beyond the bracket")
    for _ in range(steps):
        mid = (a + b) / 2
        up = tail(mid) > p
        a, b = np.where(up, mid, a), np.where(up, b, mid)
    return (a + b) / 2


def t_quantile_two_sided(p, df) -> np.ndarray:
    """t with two-sided tail p."""
    df = np.asarray(df, float)
    return bisect(lambda t: t_two_sided(t, df), p, 0.0)


def f_quantile_upper(p, d1, d2) -> np.ndarray:
    return bisect(lambda f: f_upper(f, d1, d2), p, 0.0)


def normal_quantile_two_sided(p) -> np.ndarray:
    return bisect(lambda z: 2 * normal_upper(z), p, 0.0)


#: Signs up to which the sign test's p is given as a fraction; its digits grow with them.
FRACTION_SIGNS = 10_000


def fisher_right(hits: int, drawn: int, marked: int, total: int) -> float:
    """One tail of :func:`tails.fisher_right_tail`."""
    return float(fisher_right_tail(np.array([hits]), np.array([drawn]), np.array([marked]), np.array([total]))[0])


def sign_test(positive: int, negative: int) -> tuple[float, str]:
    """Exact two-sided sign test: p, and p as a reduced fraction of integers."""
    n = positive + negative
    if n == 0:
        return 1.0, "1/1"
    tail = term = 1
    for k in range(min(positive, negative)):
        term = term * (n - k) // (k + 1)
        tail += term
    top, bottom = min(2 * tail, 1 << n), 1 << n
    g = math.gcd(top, bottom)
    return top / bottom, f"{top // g}/{bottom // g}"


def mann_whitney_counts(n1: int, n2: int) -> list[int]:
    """How many orderings give each U, by dynamic programming over exact integers."""
    counts = [[0] * (n1 * n2 + 1) for _ in range(n2 + 1)]
    for row in counts:
        row[0] = 1
    for i in range(1, n1 + 1):
        fresh = [[0] * (n1 * n2 + 1) for _ in range(n2 + 1)]
        fresh[0][0] = 1
        for j in range(1, n2 + 1):
            for u in range(i * j + 1):
                fresh[j][u] = fresh[j - 1][u - i] if u >= i else 0
                fresh[j][u] += counts[j][u]
        counts = fresh
    return counts[n2]


def mann_whitney_p(u: float, n1: int, n2: int) -> float:
    """Exact two-sided p of U without ties."""
    counts = mann_whitney_counts(n1, n2)
    k = int(min(u, n1 * n2 - u))
    return min(1.0, 2 * sum(counts[: k + 1]) / sum(counts))


def mann_whitney_two_sided(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of U: exact counts for groups of at most MAX_EXACT without ties, else the normal form with variance
    corrected for ``ties``, the sum of t^3 - t over sets of t equal values, and a continuity correction. NaN for an empty group."""
    if not n1 or not n2:
        return math.nan
    if not ties and max(n1, n2) <= MAX_EXACT:
        return mann_whitney_p(u, n1, n2)
    n = n1 + n2
    variance = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    away = max(abs(u - n1 * n2 / 2) - 0.5, 0.0)
    return math.erfc(away / math.sqrt(2 * variance)) if variance > 0 else 1.0


def _over(fn, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        values = [s.astype(float).to_numpy() for s in series]
        out = np.full(len(values[0]), np.nan)
        ok = ~np.any([np.isnan(v) for v in values], axis=0)
        if ok.any():
            out[ok] = fn(*[v[ok] for v in values])
        return pd.Series(out).where(~np.isnan(out), None)

    return F.nanvl(run(*[c.cast("double") for c in columns]), F.lit(None).cast("double"))


def t_two_sided_p(t: Column, df: Column) -> Column:
    return _over(t_two_sided, t, df)


def f_upper_p(f: Column, d1: Column, d2: Column) -> Column:
    return _over(f_upper, f, d1, d2)


def chi2_upper_p(x: Column, df: Column) -> Column:
    return _over(chi2_upper, x, df)


def chi2_lower_p(x: Column, df: Column) -> Column:
    return _over(chi2_lower, x, df)


def normal_two_sided_p(z: Column) -> Column:
    return _over(lambda v: 2 * normal_upper(np.abs(v)), z)


def t_quantile(p: Column, df: Column) -> Column:
    return _over(t_quantile_two_sided, p, df)


def fisher_right_p(hits: Column, drawn: Column, marked: Column, total: Column) -> Column:
    return _over(fisher_right_tail, hits, drawn, marked, total)


def sign_test_p(positive: Column, negative: Column) -> Column:
    return _over(sign_two_sided, positive, negative)


def mann_whitney_two_sided_p(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    return _over(lambda *v: np.array([mann_whitney_two_sided(x, int(a), int(b), t) for x, a, b, t in zip(*v)]), u, n1, n2, ties)


def sign_test_fraction(positive, negative) -> Column:
    """p of the sign test as "numerator/denominator" of exact integers; NULL over FRACTION_SIGNS signs, where sign_test_p has it."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) or x + y > FRACTION_SIGNS else sign_test(int(x), int(y))[1] for x, y in zip(a, b)])

    return run(positive, negative)

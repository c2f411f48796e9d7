"""Hypergeometric and binomial tails over columns of groups, for counts of any size.

A tail is its first term times a sum of ratios of neighbouring terms. The first term comes from Stirling remainders and
deviances, whose rounding doesn't grow with the counts as that of log-gamma differences does. The sum runs away from the
mode, where terms only fall, and stops when what is left can't change it: about nine standard deviations at most, however
large the class. Of the two tails the one beyond the mode is summed, and the other is its complement.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Terms of a tail that are added at once; share of the sum that is left out at the end.
TERMS, REST = 256, 1e-17
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
_SMALL = np.array([0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - _HALF_LOG_2PI for n in range(1, 16)])


def stirling_rest(n: np.ndarray) -> np.ndarray:
    """log(n!) less Stirling's formula; 0 for n = 0, whose terms are handled apart."""
    m = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / (m * m)) / (m * m)) / (m * m)) / (m * m)) / m
    return np.where(n < 16, _SMALL[np.minimum(n, 15).astype(int)], series)


def deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    with np.errstate(divide="ignore", invalid="ignore"):
        v = (x - mean) / (x + mean)
        far = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    total, power, square = (x - mean) * v, 2 * x * v, v * v
    for j in range(1, 60):
        power = power * square
        total = total + power / (2 * j + 1)
    return np.where(np.abs(x - mean) < 0.1 * (x + mean), total, far)


def binomial_term(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X = k) of n trials."""
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    q = 1 - p
    inner = (k > 0) & (k < n)
    i, m = np.where(inner, k, 1.0), np.where(inner, n, 2.0)
    with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
        log = stirling_rest(m) - stirling_rest(i) - stirling_rest(m - i) - deviance(i, m * p) - deviance(m - i, m * q)
        middle = np.exp(log) * np.sqrt(m / (2 * math.pi * i * (m - i)))
        ends = np.where(k == 0, np.exp(np.where(n > 0, n * np.log1p(-p), 0.0)), np.exp(np.where(n > 0, n * np.log(p), 0.0)))
    return np.where(inner, middle, np.where((k < 0) | (k > n), 0.0, ends))


def hypergeometric_term(k, drawn, marked, total) -> np.ndarray:
    """P(X = k) marked among ``drawn`` of ``total``: two binomial terms over a third, at the share that is drawn."""
    k, d, m, n = (np.asarray(v, float) for v in (k, drawn, marked, total))
    p = np.where(n > 0, d / np.maximum(n, 1), 0.0)
    sure = (p <= 0) | (p >= 1)
    share = np.where(sure, 0.5, p)
    usual = binomial_term(k, m, share) * binomial_term(d - k, n - m, share) / binomial_term(np.where(sure, 0, d), np.where(sure, 0, n), share)
    return np.where(sure, (k == np.where(p >= 1, m, 0)).astype(float), usual)


def falling_sum(first: np.ndarray, ratio: Callable[[np.ndarray, np.ndarray], np.ndarray], terms: int = TERMS) -> np.ndarray:
    """Sums of terms that fall: ``first``, then each times ``ratio(rows, step)`` for steps 0, 1, ..."""
    out = np.array(first, float)
    last, live, at = out.copy(), np.flatnonzero(out > 0), 0
    while len(live):
        steps = ratio(live[:, None], np.arange(at, at + terms)[None, :])
        block = last[live][:, None] * np.cumprod(steps, axis=1)
        out[live] += block.sum(axis=1)
        end, r = block[:, -1], np.clip(steps[:, -1], 0, 1 - 1e-12)
        last[live] = end
        live = live[end * r / (1 - r) > REST * out[live]]
        at += terms
    return out


def fisher_right_tail(hits, drawn, marked, total) -> np.ndarray:
    """P(at least ``hits`` marked among ``drawn`` of ``total``, ``marked`` of them marked); NaN for an impossible table."""
    h, d, m, n = (np.asarray(v, float) for v in np.broadcast_arrays(hits, drawn, marked, total))
    ok = (np.minimum(np.minimum(h, d), np.minimum(m, n)) >= 0) & (d <= n) & (m <= n) & (h <= np.minimum(d, m)) & (d - h <= n - m)
    out = np.full(h.shape, np.nan)
    h, d, m, n = (v[ok] for v in (h, d, m, n))
    upper = h > (d + 1) * (m + 1) / (n + 2)  # beyond the mode
    start = np.where(upper, h, h - 1)

    def ratio(rows, step):
        up, k = upper[rows], np.where(upper[rows], start[rows] + step, start[rows] - step)
        a, b, c = d[rows], m[rows], n[rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            rise = (b - k) * (a - k) / ((k + 1) * (c - b - a + k + 1))
            fall = k * (c - b - a + k) / ((b - k + 1) * (a - k + 1))
        return np.where(up, np.where(k < np.minimum(a, b), rise, 0.0), np.where((k > 0) & (c - b - a + k > 0), fall, 0.0))

    tail = falling_sum(hypergeometric_term(start, d, m, n), ratio)
    value = np.where(upper, tail, 1 - tail)
    out[ok] = np.where(h <= np.maximum(0, d + m - n), 1.0, np.clip(value, 0.0, 1.0))
    return out


def sign_two_sided(positive, negative) -> np.ndarray:
    """Two-sided sign test: twice the smaller tail of fair coins, 1 at most, and 1 without any sign."""
    a, b = (np.asarray(v, float) for v in np.broadcast_arrays(positive, negative))
    k, n = np.minimum(a, b), a + b
    tail = falling_sum(binomial_term(k, n, np.full(n.shape, 0.5)), lambda rows, step: np.maximum(k[rows] - step, 0) / (n[rows] - np.maximum(k[rows] - step, 0) + 1))
    return np.where(n == 0, 1.0, np.where(a == b, 1.0, np.minimum(1.0, 2 * tail)))

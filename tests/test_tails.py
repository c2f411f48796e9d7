"""Tails against exact integers, up to classes of a million, and how much work they take."""

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest

from veridex.functions import kernels, tails


def exact_fisher(h, d, m, n):
    """A ratio of integers: term by term from the first possible one."""
    low, high = max(0, d + m - n), min(d, m)
    term = total = above = 0
    term = math.comb(m, low) * math.comb(n - m, d - low)
    for k in range(low, high + 1):
        total += term
        if k >= h:
            above += term
        term = term * (m - k) * (d - k) // ((k + 1) * (n - m - d + k + 1))
    return float(Fraction(above, total))


def decimal_fisher(h, d, m, n):
    """60 digits, for classes whose integers are too long: terms relative to the mode."""
    with localcontext() as c:
        c.prec = 60
        mode = (d + 1) * (m + 1) // (n + 2)
        low, high = max(0, d + m - n), min(d, m)
        total = above = Decimal(0)
        term, k = Decimal(1), mode
        while k <= high and (term > Decimal("1e-330")):
            total, above = total + term, above + (term if k >= h else 0)
            term = term * ((m - k) * (d - k)) / ((k + 1) * (n - m - d + k + 1))
            k += 1
        term, k = Decimal(1), mode
        while k > low and term > Decimal("1e-330"):
            term = term * (k * (n - m - d + k)) / ((m - k + 1) * (d - k + 1))
            k -= 1
            total, above = total + term, above + (term if k >= h else 0)
        return float(above / total)


def test_small_tables_equal_exact_integers():
    cases = [(h, d, m, n) for n in (1, 2, 7, 12) for d in range(n + 1) for m in range(n + 1) for h in range(min(d, m) + 1) if d - h <= n - m]
    got = tails.fisher_right_tail(*map(np.array, zip(*cases)))
    assert np.allclose(got, [exact_fisher(*c) for c in cases], rtol=1e-13, atol=0)


def test_middle_tables_equal_exact_integers():
    rng = np.random.default_rng(1)
    cases = []
    for n in (300, 2_000, 20_000):
        for _ in range(12):
            d, m = int(rng.integers(1, n // 4)), int(rng.integers(1, n // 4))
            for h in {0, d * m // n, d * m // n + 5, int(d * m / n + 6 * math.sqrt(d * m / n) + 1), min(d, m)}:
                if h <= min(d, m):
                    cases.append((h, d, m, n))
    got = tails.fisher_right_tail(*map(np.array, zip(*cases)))
    for c, p in zip(cases, got):
        want = exact_fisher(*c)
        assert p == pytest.approx(want, rel=1e-12, abs=1e-300), c


def test_classes_of_a_million():
    cases = [(250_000, 500_000, 500_000, 10**6), (250_400, 500_000, 500_000, 10**6), (252_000, 500_000, 500_000, 10**6), (249_000, 500_000, 500_000, 10**6), (1_200, 100_000, 10_000, 10**6), (900, 100_000, 10_000, 10**6), (30, 1_000, 1_000, 10**6), (3, 1_000, 1_000, 10**6)]
    got = tails.fisher_right_tail(*map(np.array, zip(*cases)))
    for c, p in zip(cases, got):
        assert p == pytest.approx(decimal_fisher(*c), rel=1e-12), c


def test_work_does_not_grow_with_the_class(monkeypatch):
    steps = []
    plain = np.cumprod
    monkeypatch.setattr(tails.np, "cumprod", lambda x, axis: steps.append(x.shape[1]) or plain(x, axis=axis))
    tails.fisher_right_tail(np.array([250_001]), np.array([500_000]), np.array([500_000]), np.array([10**6]))
    assert sum(steps) < 10 * math.sqrt(10**6 / 16)


def test_sign_tails():
    cases = [(a, b) for a in range(12) for b in range(12)] + [(500, 520), (400, 620), (5_000, 5_400), (0, 900)]
    got = tails.sign_two_sided(*map(np.array, zip(*cases)))
    for (a, b), p in zip(cases, got):
        assert p == pytest.approx(kernels.sign_test(a, b)[0], rel=1e-12), (a, b)
    p = tails.sign_two_sided(np.array([500_500]), np.array([499_500]))[0]
    assert p == pytest.approx(math.erfc((1_000 - 1) / math.sqrt(10**6) / math.sqrt(2)), rel=1e-3)


def test_impossible_tables_and_fractions(spark):
    from pyspark.sql import functions as F

    assert np.isnan(tails.fisher_right_tail([5, -1, 1, 0], [4, 1, 1, 9], [9, 1, 8, 2], [10, 3, 7, 10])).all()
    assert tails.fisher_right_tail([0], [0], [0], [0])[0] == 1.0
    rows = spark.createDataFrame([(3, 5), (0, 0), (None, 1), (6_000, 6_000)], "a bigint, b bigint")
    got = [r.f for r in rows.select(kernels.sign_test_fraction(F.col("a"), F.col("b")).alias("f")).collect()]
    assert got == ["93/128", "1/1", None, None]

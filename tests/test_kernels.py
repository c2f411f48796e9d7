"""Closed forms and brute force for the statistical kernels."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.functions import kernels as K
from veridex.functions import stats
from veridex.operators import linalg, subspace


def test_beta_and_tails_have_closed_forms():
    x = np.array([0.1, 0.5, 0.9])
    assert np.allclose(K.betainc(1, 1, x), x, atol=1e-14)
    assert np.allclose(K.betainc(2, 1, x), x**2, atol=1e-14)
    assert np.allclose(K.t_two_sided(np.array([1.0, 12.7062047364]), 1), [0.5, 0.05], atol=1e-9)
    assert np.allclose(K.t_two_sided(np.array([2.2281388520]), 10), 0.05, atol=1e-9)
    assert np.allclose(K.chi2_upper(np.array([3.8414588207, 5.9914645471]), np.array([1, 2])), 0.05, atol=1e-9)
    assert np.allclose(K.f_upper(np.array([4.9646027437]), 1, 10), 0.05, atol=1e-8)
    assert np.allclose(K.normal_upper(np.array([1.959963984540054])), 0.025, atol=1e-12)
    assert np.isnan(K.betainc(-1, 1, 0.5)) and np.isnan(K.betainc(1, 1, 2.0))


def test_quantiles_invert_tails():
    p = np.array([0.5, 0.05, 1e-6])
    assert np.allclose(K.t_two_sided(K.t_quantile_two_sided(p, 7), 7), p, rtol=1e-9)
    assert np.allclose(K.f_upper(K.f_quantile_upper(p, 3, 9), 3, 9), p, rtol=1e-8)
    assert np.allclose(K.normal_quantile_two_sided(np.array([0.05])), stats.Z95, atol=1e-9)


def test_fisher_is_the_hypergeometric_tail():
    for total, marked, drawn in ((10, 4, 5), (12, 6, 3)):
        ways = list(itertools.combinations(range(total), drawn))
        for hits in range(min(marked, drawn) + 1):
            share = sum(sum(i < marked for i in w) >= hits for w in ways) / len(ways)
            assert math.isclose(K.fisher_right(hits, drawn, marked, total), share)
    assert math.isnan(K.fisher_right(5, 4, 9, 10))
    assert math.isclose(K.fisher_right(30, 60, 2000, 6000), math.fsum(math.comb(2000, k) * math.comb(4000, 60 - k) / math.comb(6000, 60) for k in range(30, 61)), rel_tol=1e-9)


def test_mann_whitney_counts_enumerate():
    for n1, n2 in ((2, 3), (3, 3), (1, 4)):
        seen = [0] * (n1 * n2 + 1)
        for chosen in itertools.combinations(range(n1 + n2), n1):
            seen[sum(c - i for i, c in enumerate(chosen))] += 1
        assert K.mann_whitney_counts(n1, n2) == seen


def test_sign_test_is_exact():
    assert K.sign_test(5, 0) == (0.0625, "1/16")
    assert K.sign_test(0, 0) == (1.0, "1/1")
    assert K.sign_test(3, 3)[0] == 1.0


def test_paired_t_edge_cases(spark):
    rows = spark.createDataFrame([(1, 2.0, None), (5, 0.0, 0.0), (5, 1.0, 0.0), (5, 1.0, 1.0)], "n bigint, m double, s double")
    p = [r.p for r in rows.select(stats.paired_t_p(F.col("n"), F.col("m"), F.coalesce("s", F.lit(0.0))).alias("p")).collect()]
    assert p[0] == 1.0 and p[1] == 1.0 and p[2] == 1e-300 and 0 < p[3] < 0.1


def test_paired_ci_recovers_the_standard_error(spark):
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(stats.paired_ci(F.lit(1.0), F.lit(0.05), F.lit(10)), ("low", "high"))]).first()
    assert abs(row.low) < 1e-9 and abs(row.high - 2.0) < 1e-9


def test_eigen_and_lcg():
    a = np.random.default_rng(1).normal(size=(12, 12))
    a = a @ a.T
    values, vectors, residuals = subspace.leading(lambda block: a @ block, 12, 12)
    assert residuals.max() < 1e-12 * values[0] and np.allclose(vectors @ np.diag(values) @ vectors.T, a) and np.allclose(vectors.T @ vectors, np.eye(12))
    assert (np.diff(values) <= 1e-9).all()
    g = linalg.Lcg(42)
    assert sorted(g.shuffled(range(20))) == list(range(20)) and linalg.Lcg(42).shuffled(range(20)) == linalg.Lcg(42).shuffled(range(20))
    big = np.random.default_rng(2).normal(size=(500, 500))
    big = big @ big.T
    values, vectors, residuals = subspace.leading(lambda block: big @ block, 500, 4)
    assert np.allclose(values, np.linalg.eigvalsh(big)[::-1][:4], rtol=1e-11) and residuals.max() < 1e-9 * values[0]


def test_published_numbers(spark):
    rows = spark.createDataFrame([(-1e-12,), (float("nan"),), (float("inf"),), (1.23456789012,)], "x double")
    got = [r.x for r in rows.select(stats.published(F.col("x")).alias("x")).collect()]
    assert got[0] == 0.0 and math.copysign(1, got[0]) == 1 and got[1] is None and got[2] is None and got[3] == 1.2345678901

"""Exact quantiles of groups of any size, against numpy."""

import random

import numpy as np
import pytest

from veridex.operators.ranks import quantiles

AT = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [("hot", rng.choice(["x", None]), rng.gauss(0, 10)) for _ in range(3_000)]  # one group holds most rows
    out += [("ties", "x", float(rng.randint(0, 3))) for _ in range(200)] + [(None, "x", float(i)) for i in range(4)]
    return out + [("one", "x", 7.0), ("none", "x", None), ("ties", "x", None)]


@pytest.mark.parametrize("small", [0, 1_000_000], ids=["ranges", "groups"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_quantiles_of_groups(spark, rows, partitions, small):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, "a string, b string, v double")
        for by in (["a", "b"], ["a"], []):
            got = {tuple(r[c] for c in by): r.q for r in quantiles(df, by, "v", AT, "q", small).collect()}
            held = {}
            for a, b, v in rows:
                if v is not None:
                    held.setdefault(tuple({"a": a, "b": b}[c] for c in by), []).append(v)
            assert got.keys() == held.keys()
            for key, values in held.items():
                assert np.allclose(got[key], np.quantile(values, AT), rtol=1e-12, atol=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_quantiles_without_rows(spark):
    empty = spark.createDataFrame([], "a string, v double")
    for small in (-1, 0, 10):
        assert quantiles(empty, ["a"], "v", AT, "q", small).collect() == []
        assert [r.q for r in quantiles(empty, [], "v", AT, "q", small).collect()] in ([], [None], [[None] * len(AT)])

"""Averages that no order of the rows changes, and the signs of changes between them."""

import datetime as dt
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from veridex import registry
from veridex.functions import stats

EARLY, LATE = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 20)


def write_events(spark, path, rows, parts):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, t, u, "view", v, "") for i, (u, t, v) in enumerate(rows)], schema).repartition(parts).write.parquet(str(path / "events.parquet"))
    return str(path)


def near_means():
    """Rows of 2,000 users whose means are equal or next to it, and the signs of their changes by integers."""
    rng, rows, signs = random.Random(7), [], []
    for user in range(2000):
        before = [rng.randint(1, 900) for _ in range(rng.randint(1, 9))]
        after = rng.sample(before, len(before)) * rng.randint(1, 3)
        after[0] += user % 3 - 1 if after[0] > 1 else 0
        rows += [(user, EARLY, v / 100) for v in before] + [(user, LATE, v / 100) for v in after]
        a, b = Fraction(sum(after), len(after)), Fraction(sum(before), len(before))
        signs.append((a > b) - (a < b))
    assert signs.count(0) > 600
    rng.shuffle(rows)
    return rows, [signs.count(s) for s in (1, -1, 0)]


@pytest.mark.parametrize("parts", [1, 5])
def test_equal_means_are_ties_of_the_sign_test(spark, tmp_path, parts):
    """Sums of doubles found 420 of 668 ties in one file, 467 in five."""
    rows, signs = near_means()
    r = registry.queries()["sign_test"](spark, write_events(spark, tmp_path, rows, parts)).first()
    assert (r.complete_pairs, r.positives, r.negatives, r.ties) == (2000, *signs)


@pytest.mark.parametrize(
    "values,mean",
    [([0.1, 0.2, 0.3], 0.2), ([0.3, 0.3, 0.3, None], 0.3), ([-0.3, 0.1], -0.1), ([], None), ([None], None), ([1e-7, 3e-7], 2e-7), ([1e300, 1e300], 1e300), ([9e15, 1.0], 4.5e15), ([1e-9, 1.0], 0.5000000005), ([float("inf"), 1.0], float("inf")), ([float("nan"), 1.0], float("nan"))],
)
def test_steady_avg(spark, values, mean):
    """Values beyond the decimals or the whole numbers have the plain average; no value is left out."""
    got = spark.createDataFrame([(v,) for v in values], "v double").agg(stats.steady_avg(F.col("v")).alias("m")).first().m
    assert got == mean or got == pytest.approx(mean, rel=1e-15, nan_ok=True)


@pytest.mark.parametrize("parts", [1, 5])
def test_participants_with_equal_means_are_unchanged(spark, tmp_path, parts):
    """Sums of doubles called 248 or 201 of 668 such participants increased or decreased."""
    rows, signs = near_means()
    found = {r.response: r.participants for r in registry.queries()["participant_response"](spark, write_events(spark, tmp_path, rows, parts)).collect()}
    assert found == dict(zip(("increased", "decreased", "unchanged"), signs))


def test_participants_without_dates_or_of_far_means_are_counted(spark, tmp_path):
    """Before, user 1 was dropped and user 2, whose fold is under the least double, was an incomplete pair."""
    rows = [(1, None, 5.0), (2, EARLY, 1e300), (2, LATE, 1e-300), (3, EARLY, 1.0), (3, None, 9.0), (4, None, None), (None, EARLY, 2.0), (None, LATE, 3.0), (5, EARLY, 0.0), (5, LATE, 1.0)]
    path = write_events(spark, tmp_path, rows, 1)
    found = {(r.event_type, r.response, r.participants) for r in registry.queries()["participant_response"](spark, path).collect()}
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    assert found == {("view", "incomplete_pair", 4), ("view", "decreased", 1), ("view", "increased", 1)} == set(con.execute(registry.oracles()["participant_response"]).fetchall())

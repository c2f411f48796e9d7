"""Pairs of a block: each once, from its least block, in even tiles."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from veridex.operators import blocking


def plain(rows):
    own = {(k, v) for k, v in rows if k is not None and v is not None}
    by = {}
    for k, v in own:
        by.setdefault(v, set()).add(k)
    out = {}
    for v, keys in sorted(by.items(), key=lambda i: (len(i[1]), i[0])):
        for a, b in itertools.combinations(sorted(keys), 2):
            out.setdefault((a, b), (v, len(keys)))
    return {(a, b, *w) for (a, b), w in out.items()}


@pytest.mark.parametrize("tile", [2, 7, 128])
def test_every_pair_once_from_its_least_block(spark, tile):
    rng = random.Random(tile)
    rows = [(rng.randrange(80), f"v{min(int(rng.expovariate(0.3)), 12)}") for _ in range(400)] + [(k, "hot") for k in range(60)]
    rows += rows[:20] + [(None, "hot"), (5, None), (7, "alone")]
    df = spark.createDataFrame(rows, "k bigint, v string").repartition(5)
    found = [tuple(r) for r in blocking.shared_pairs(df, "k", "v", tile).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows)
    told = {r.value: (r.records, r.pairs) for r in blocking.sizes(df, "k", "v").collect()}
    assert told["hot"] == (60, 60 * 59 // 2) and "alone" not in told


def test_a_hot_value_makes_even_tasks(spark):
    n = 3_000
    df = spark.range(n).select("id", F.lit("hot").alias("v")).union(spark.range(n).select("id", F.concat(F.lit("own"), F.col("id")).alias("v")))
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        pairs = blocking.shared_pairs(df, "id", "v", tile=64)
        tasks = sorted(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(tasks) == n * (n - 1) // 2 and len(tasks) == 32 and tasks[-1] < 2 * tasks[len(tasks) // 2]


def test_no_rows(spark):
    assert blocking.shared_pairs(spark.createDataFrame([], "k int, v string"), "k", "v").count() == 0


@pytest.mark.parametrize("deepest", [8, 1])
def test_totals_are_those_of_all_pairs(spark, deepest):
    rng = random.Random(deepest)
    rows = [(rng.randrange(-20, 80), f"v{min(int(rng.expovariate(0.4)), 9)}") for _ in range(240)] + [(k, "hot") for k in range(60)]
    rows += rows[:20] + [(None, "hot"), (5, None), (7, "alone")]
    want = {}
    for low, high, block, records in plain(rows):
        n, a, b = want.get((block, records), (0, 0, 0))
        want[block, records] = (n + 1, a + low, b + high)
    found = blocking.shared_totals(spark.createDataFrame(rows, "k bigint, v string").repartition(5), "k", "v", deepest).collect()
    assert {(r.block, r.block_records): (r.pairs, r.left_sum, r.right_sum) for r in found} == want


def test_copies_of_rows_are_not_broadcast(spark):
    """A block of n records sends each to n / 256 tiles, which the size of its file doesn't show."""
    df = spark.range(500).select("id", F.lit("hot").alias("v"))
    plan = blocking.shared_pairs(df, "id", "v")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

"""op3_host_rules as registered, on a table in which hosts are rejected, against its SQL."""

import random

import harness
from conftest import prose

from veridex.llm import oracles, queries


def test_registered_query_rejects_a_host(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "spam " * 3, "bad") for i in range(90)] + [(90 + i, prose(rng, 30), "bad") for i in range(4)]
    rows += [(200 + i, prose(rng, 25) if i % 9 else "x", f"ok{i % 12}" if i % 13 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for name in harness.TABLES:
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (next((tmp_path / name).glob("*.parquet"))).rename(tmp_path / f"{name}.parquet")
    query = queries.queries()["op3_host_rules"]
    got = query(spark, str(tmp_path)).collect()
    assert sum(not r.base_failed and not r.kept for r in got) == 4
    n, difference = harness.compare(spark, str(tmp_path), query, oracles.SQL["op3_host_rules"])
    assert n == len(rows) and not difference, difference

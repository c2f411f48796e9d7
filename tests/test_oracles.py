"""Every registered query against its DuckDB oracle, and each result against reordered input."""

import pytest

import harness
from veridex import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    rows, difference = harness.compare(spark, sf_dir, QUERIES[name], ORACLES[name])
    assert not difference, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs_twice_alike(spark, sf_dir, name):
    first, second = (QUERIES[name](spark, sf_dir) for _ in range(2))
    assert harness.canonical(first.columns, [tuple(r) for r in first.collect()]) == harness.canonical(second.columns, [tuple(r) for r in second.collect()])


@pytest.mark.parametrize("name", ["paired_effect_bh", "class_enrichment", "entity_dedup", "similarity_ranking"])
def test_row_order_does_not_matter(spark, sf_dir, name, tmp_path, monkeypatch):
    def shuffled(session, folder, table):
        from pyspark.sql import functions as F

        return session.read.parquet(f"{folder}/{table}.parquet").orderBy(F.xxhash64(F.col(session.read.parquet(f"{folder}/{table}.parquet").columns[0]), F.lit(3))).repartition(5)

    import sys

    module = sys.modules[QUERIES[name].__module__]
    plain = QUERIES[name](spark, sf_dir)
    expected = harness.canonical(plain.columns, [tuple(r) for r in plain.collect()])
    monkeypatch.setattr(module, "table", shuffled)
    mixed = QUERIES[name](spark, sf_dir)
    assert harness.canonical(mixed.columns, [tuple(r) for r in mixed.collect()]) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Queries on all rows: SQL without row filters, and what SQL cannot express."""

import itertools
import math

import numpy as np
import pytest

from veridex import registry
from veridex.functions import kernels
from veridex.operators import linalg

ALL_ROWS = {"assay_scope_category": "lineitem", "gram_matrix": "embeddings", "inference_ledger": "orders", "effect_heatmap_grid": "part", "lookup_unambiguous": "lineitem", "explode_matrix": "orders"}


@pytest.mark.parametrize("name", sorted(ALL_ROWS))
def test_no_rows_are_filtered_by_id(name):
    """Neither the SQL nor the plan keeps some rows of its table only."""
    sql = registry.oracles()[name]
    assert not [f for f in (" % 40 = 0", "vec_id < 40", " % 97 = 0", "p_size <=", "l_linenumber = 1", " % 20 = 0") if f in sql]


def test_mann_whitney_counts_all_events(spark, sf_dir):
    """Against pairs counted one by one, and the tie-corrected variance written out."""
    events = [r for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect() if r.event_type in ("click", "purchase") and r.value is not None]
    x, y = (np.array([r.value for r in events if r.event_type == t]) for t in ("click", "purchase"))
    u = (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2
    _, t = np.unique(np.concatenate([x, y]), return_counts=True)
    n, m = len(x) + len(y), len(x) * len(y)
    sd = math.sqrt(m / 12 * (n + 1 - float((t.astype(float) ** 3 - t).sum()) / (n * (n - 1))))
    got = registry.queries()["mann_whitney"](spark, sf_dir).first()
    assert (got.positives, got.negatives) == (len(x), len(y)) and math.isclose(got.auroc, u / m, abs_tol=1e-9)
    assert math.isclose(got.p_value, math.erfc(max(abs(u - m / 2) - 0.5, 0) / sd / math.sqrt(2)), rel_tol=1e-9)


def test_mann_whitney_forms_agree():
    assert kernels.mann_whitney_two_sided(3, 4, 5, 0) == kernels.mann_whitney_p(3, 4, 5)
    n = kernels.MAX_EXACT
    assert all(abs(kernels.mann_whitney_p(u, n, n) - kernels.mann_whitney_two_sided(u, n, n, 1e-9)) < 5e-3 for u in (100, 200, 250, 312))
    assert kernels.mann_whitney_two_sided(2, 2, 2, 4**3 - 4) == 1.0 and math.isnan(kernels.mann_whitney_two_sided(0, 0, 3, 0))


@pytest.mark.parametrize("block", [1, 3, 256])
def test_gram_in_blocks(spark, block):
    rows = [(k, [float(k), None if k % 3 == 0 else 2.0, -float(k)][: 3 - k % 2]) for k in range(8)] + [(8, None), (9, []), (10, [None])]
    got = {(r.i, r.j): r.value for r in linalg.gram(spark.createDataFrame(rows, "k bigint, v array<double>"), "k", "v", block).collect()}
    kept = [(k, v) for k, v in rows if v is not None]
    want = {}
    for (i, a), (j, b) in itertools.combinations_with_replacement(kept, 2):
        terms = [p * q for p, q in zip(a, b) if p is not None and q is not None]
        want[i, j] = sum(terms) if terms else None
    assert got == want


def test_gram_sends_few_copies_and_gives_batches(spark):
    """A row was sent to n / 256 blocks: 469 copies of each of 120,000 rows."""
    n, width = 120_000, 64
    block = linalg.block_rows(n, width)
    assert -(-n // block) <= 16 and block * width * 8 <= linalg.BLOCK_BYTES and linalg.block_rows(10, 1 << 24) == 1
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1_200, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k bigint, v array<float>")
    got = linalg.gram(df, "k", "v", digits=7).toPandas()
    assert len(got) == 1_200 * 1_201 // 2 and not got.duplicated(["i", "j"]).any() and (got.i <= got.j).all()
    want = (x.astype(float) @ x.astype(float).T)[got.i, got.j]
    assert np.abs(got.value - want).max() < 1e-7


def test_gram_shuffles_no_rows(spark):
    """Each row was shuffled once for every block. Now blocks are staged once and read again; keys of any type are packed."""
    x = np.random.default_rng(4).integers(-9, 9, size=(70, 3)).astype(float)
    df = spark.createDataFrame([(f"k{i:02}", r.tolist()) for i, r in enumerate(x)], "k string, v array<double>").repartition(5)
    found = linalg.gram(df, "k", "v", block=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    assert {(r.i, r.j): r.value for r in found.collect()} == {(f"k{i:02}", f"k{j:02}"): x[i] @ x[j] for i in range(70) for j in range(i, 70)}
    blocks = spark.read.parquet(*found.inputFiles())
    assert sorted(k for r in blocks.collect() for k in r.key) == [f"k{i:02}" for i in range(70)] and len(found.inputFiles()) == blocks.count()


def test_gram_of_no_rows(spark):
    assert linalg.gram(spark.createDataFrame([(1, None)], "k int, v array<float>"), "k", "v").collect() == []

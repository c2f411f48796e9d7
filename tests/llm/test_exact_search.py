"""Exact top-k against brute force, and what pruning leaves out."""

import math

import numpy as np
import pytest

from veridex.llm import exact_search

SCHEMA = "vec_id bigint, embedding array<float>, label int, chunk string, rank int, score double"


def plain(rows, every=50, top=5):
    """Rows of (vec_id, vector): sorted (query_id, rank, vec_id, score)."""
    used = [(i, [math.floor(256 * float(x)) if abs(256 * float(x)) < float("inf") else 0 for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, q) in enumerate(used):
        if i % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1), j) for m, (j, v) in enumerate(used) if m != k)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:top], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "c", 1, 0.5) for i, v in rows], SCHEMA).repartition(4)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_search.top_k(df, **options).collect())


def clustered(n, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    points = centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, width))
    return [(i, np.float32(p / np.linalg.norm(p))) for i, p in enumerate(points)]


@pytest.mark.parametrize("options", [{}, {"block": 4, "chunk": 32, "group": 3, "lane": 2}, {"block": 1, "chunk": 7}])
def test_equals_brute_force(spark, options):
    rows = clustered(400)
    rows += [(i + 1000, rows[3][1]) for i in range(30)]  # ties
    rows += [(50, rows[9][1]), (50, rows[50][1]), (-100, rows[2][1]), (None, rows[1][1]), (7777, None), (2000, [float("nan")] + [0.0] * 15), (2050, [None] * 16), (2100, [float("inf")] * 16)]
    rows += [(2150, []), (2200, [1.0, -1.0]), (2250, [0.0] * 16), (2300, [0.01] * 40)]  # other lengths
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    expected = plain(rows, top=5)
    assert run(spark, rows, **options) == expected and len(expected) > 60


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    for scale in (1e3, 1e7, 1e12, 1e30):
        rows = [(i, [float(x) for x in np.float32(scale * v)]) for i, v in enumerate(rng.normal(size=(120, 6)))]
        assert run(spark, rows, block=4, chunk=16) == plain(rows)


def test_few_and_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, [0.5]), (2, [0.5])]) == [] and run(spark, [(0, [0.5])]) == []
    assert run(spark, [(0, [0.5]), (3, [0.25]), (50, [-0.5])]) == [(0, 1, 3, 128 * 64), (0, 2, 50, -128 * 128), (50, 1, 3, -128 * 64), (50, 2, 0, -128 * 128)]


def test_blocks_under_the_kth_score_are_not_scored():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(32, 64))
    values = np.floor(256 * (np.repeat(centres, 64, axis=0) / 8 + 0.01 * rng.normal(size=(2048, 64)))).astype("<i2")
    ids = np.arange(2048)
    on = np.arange(0, 2048, 64)
    ask = {"ids": ids[on].astype("<i8").tobytes(), "chunks": np.zeros(len(on), "<i8").tobytes(), "places": on.astype("<i8").tobytes(), "floors": np.full(len(on), exact_search.LONG[0], "<i8").tobytes(), "width": 64, "wide": False, "vectors": values[on].tobytes()}
    seen = []
    found = exact_search.search_chunk(ids, values, ask, 0, 5, 64, seen)
    assert found.num_rows == 5 * len(on) and sum(seen) < 0.1 * len(on) * len(ids)


def test_every_vector_is_indexed(spark):
    rows = clustered(1000)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>").repartition(6)
    held = exact_search.with_numbers(exact_search.index(df, block=8, chunk=64)).collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<i8") for r in held])
    assert sorted(ids) == list(range(1000)) and sorted(r.chunk for r in held) == list(range(len(held)))

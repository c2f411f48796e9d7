"""Principal components against numpy: wide tables, both ways to multiply, odd rows, signs, degenerate spectra."""

import numpy as np
import pytest

from veridex.operators import subspace


def table(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, x array<double>").repartition(parts)


def spectrum(rng, n, width):
    """Rows with a falling spectrum far from the origin."""
    return rng.normal(size=(n, width)) * (0.97 ** np.arange(width)) @ np.linalg.qr(rng.normal(size=(width, width)))[0] + 50 * rng.normal(size=width)


def expected(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    vectors = vectors[:, ::-1][:, :k]
    return values[::-1][:k], vectors * np.where(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(k)] < 0, -1, 1)


@pytest.mark.parametrize("tiled", [subspace.TILED, 10], ids=["tiles", "rows"])
def test_a_thousand_features(spark, tiled):
    x = spectrum(np.random.default_rng(1), 300, 1000)
    found = subspace.principal_components(table(spark, x), "x", 4, tiled=tiled)
    values, vectors = expected(x, 4)
    assert np.allclose(found.values, values, rtol=1e-10) and np.allclose(found.vectors, vectors, atol=1e-8)
    assert found.residuals.max() < 1e-10 * values[0] and np.abs(found.vectors.T @ found.vectors - np.eye(4)).max() < 1e-12
    assert found.trace == pytest.approx(np.trace(np.cov(x.T))) and found.identifiability == ["unique"] * 4


def test_covariance_tiles_equal_numpy(spark):
    x = spectrum(np.random.default_rng(2), 60, 21)
    rows = subspace.complete(table(spark, x), "x", 21)
    centre, n = subspace.means(rows, 21)
    assert n == 60 and np.allclose(centre, x.mean(axis=0), rtol=1e-13)
    cov = np.zeros((21, 21))
    for r in subspace.covariance_tiles(rows, 21, centre, n, tile=8).collect():
        h, w = min(8, 21 - 8 * r.a), min(8, 21 - 8 * r.b)
        body = np.frombuffer(r.body).reshape(h, w)
        cov[8 * r.a : 8 * r.a + h, 8 * r.b : 8 * r.b + w] = body
        cov[8 * r.b : 8 * r.b + w, 8 * r.a : 8 * r.a + h] = body.T
    assert np.allclose(cov, np.cov(x.T), rtol=1e-10)


def test_incomplete_rows_are_left_out(spark):
    x = spectrum(np.random.default_rng(3), 40, 6)
    odd = [(100, [None] * 6), (101, None), (102, [1.0]), (103, [float("nan")] + [0.0] * 5), (104, [float("inf")] * 6), (105, [])]
    df = table(spark, x).unionByName(spark.createDataFrame(odd, "id int, x array<double>"))
    found = subspace.principal_components(df, "x", 2)
    assert found.rows == 40 and np.allclose(found.values, expected(x, 2)[0])
    got = {r.id: (r.pc1, r.pc2) for r in subspace.scores(df, ["id"], "x", found).collect()}
    assert all(got[i] == (None, None) for i, _ in odd)
    assert np.allclose([got[i] for i in range(40)], (x - x.mean(axis=0)) @ expected(x, 2)[1], atol=1e-9)


def test_degenerate_neighbours_and_refusals(spark):
    square = np.array([[1.0, 0, 0], [-1.0, 0, 0], [0, 1.0, 0], [0, -1.0, 0], [0, 0, 0.1], [0, 0, -0.1]])
    found = subspace.principal_components(table(spark, square), "x", 1)
    assert found.identifiability == ["degenerate"]
    whole = subspace.principal_components(table(spark, square), "x", 3)
    assert whole.identifiability == ["degenerate", "degenerate", "unique"] and whole.values.sum() == pytest.approx(whole.trace)
    for k in (0, 4):
        with pytest.raises(ValueError):
            subspace.principal_components(table(spark, square), "x", k)
    with pytest.raises(ValueError):
        subspace.principal_components(table(spark, square[:1]), "x", 1)


def test_signs_go_by_the_first_label_of_ties():
    v = np.array([[-0.5, 0.5], [0.5, 0.5], [0.5, -0.5], [0.5, 0.5]])
    assert subspace.canonical_signs(v, ["b", "C", "d", "A"])[3].tolist() == [0.5, 0.5]
    assert subspace.canonical_signs(v, ["a", "C", "d", "B"])[0].tolist() == [0.5, 0.5]
    with pytest.raises(ValueError):
        subspace.canonical_signs(np.zeros((2, 1)), ["a", "b"])

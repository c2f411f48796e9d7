"""Principal components, checked in SQL by powers of the covariance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import subspace
from ..registry import query, table

K, WIDTH, COPIES, SQUARINGS = 3, 64, 16, 16

_STEP = """
 p{c}(k, i, j, x) AS (SELECT 0, i, j, x / (SELECT sum(x) FROM a{c} WHERE i = j) FROM a{c} UNION ALL SELECT k, i, j, x / t FROM (SELECT any_value(u.k) + 1 AS k, u.i, v.j, sum(u.x * v.x) AS x, sum(CASE WHEN u.i = v.j THEN sum(u.x * v.x) END) OVER () AS t FROM p{c} u JOIN p{c} v ON u.j = v.i WHERE u.k < {squarings} GROUP BY u.i, v.j)),
 q{c} AS (SELECT i, j, x FROM p{c} WHERE k = {squarings}),
 l{c} AS (SELECT sum(a.x * q.x) AS l FROM a{c} a JOIN q{c} q ON a.i = q.i AND a.j = q.j),
 m{c} AS (SELECT arg_max(i, x) AS i, max(x) AS x FROM q{c} WHERE i = j),
 v{c} AS (SELECT {c} AS component, l AS eigenvalue, q.i AS feature, q.x / sqrt(m.x) AS loading FROM q{c} q JOIN m{c} m ON q.j = m.i, l{c}),
 a{d} AS (SELECT a.i, a.j, a.x - l * q.x AS x FROM a{c} a JOIN q{c} q ON a.i = q.i AND a.j = q.j, l{c})"""
#: The covariance to the power 2^SQUARINGS is the projection on its first eigenvector; what is left of it has the next.
_PAIRS = """WITH RECURSIVE e AS (SELECT vec_id, i - 1 AS f, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)), mean AS (SELECT f, avg(x) AS m, count(*) AS n FROM e GROUP BY f),
 c AS (SELECT vec_id, f, x - m AS x FROM e JOIN mean USING (f)),
 a1 AS (SELECT u.f AS i, v.f AS j, sum(u.x * v.x) / ((SELECT max(n) FROM mean) - 1) AS x FROM c u JOIN c v USING (vec_id) GROUP BY u.f, v.f), tr AS (SELECT sum(x) AS trace FROM a1 WHERE i = j),""" + ",".join(_STEP.format(c=c, d=c + 1, squarings=SQUARINGS) for c in range(1, K + 1)) + ", v AS (" + " UNION ALL ".join(f"SELECT * FROM v{c}" for c in range(1, K + 1)) + ")"


def _checked(rows: DataFrame, largest: float) -> DataFrame:
    """Loadings with whether a component solves its equation, |A v - l v|, and is orthonormal to the others."""
    return rows.select("component", F.round("eigenvalue", 9).alias("eigenvalue"), F.round("share", 8).alias("share"), "identifiability", "feature", F.round("loading", 5).alias("loading"), (F.col("residual") <= 1e-10 * largest).alias("residual_small"), (F.col("orthonormality") <= 1e-12).alias("orthonormal"))


@query("principal_components", _PAIRS + """ SELECT component, round(eigenvalue, 9) AS eigenvalue, round(eigenvalue / trace, 8) AS share, 'unique' AS identifiability, CAST(feature AS INTEGER) AS feature, round(loading, 5) AS loading, true AS residual_small, true AS orthonormal FROM v, tr""")
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three leading components of all embeddings."""
    found = subspace.principal_components(table(spark, sf_dir, "embeddings"), "embedding", K)
    return _checked(subspace.component_rows(spark, found), float(found.values[0]))


#: Each feature in COPIES scales: the covariance of 1,024 features whose eigenpairs follow from those of 64.
_SCALE = "(1 + copy / 8.0)"


@query("principal_components_wide", _PAIRS + f""", s AS (SELECT copy, {_SCALE} AS c FROM range({COPIES}) t(copy)), n AS (SELECT sum(c * c) AS s FROM s)
SELECT component, round(eigenvalue * n.s, 9) AS eigenvalue, round(eigenvalue / trace, 8) AS share, 'unique' AS identifiability, CAST(copy * {WIDTH} + feature AS INTEGER) AS feature, round(loading * c / sqrt(n.s), 5) AS loading, true AS residual_small, true AS orthonormal FROM v, tr, s, n""")
def principal_components_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of 1,024 features."""
    wide = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(COPIES - 1)), lambda copy: F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + copy / 8.0))))
    found = subspace.principal_components(table(spark, sf_dir, "embeddings").select(wide.alias("wide")), "wide", K, WIDTH * COPIES)
    return _checked(subspace.component_rows(spark, found), float(found.values[0]))


@query("pca_scores", _PAIRS + """ SELECT vec_id, round(sum(x * loading) FILTER (component = 1), 6) AS pc1, round(sum(x * loading) FILTER (component = 2), 6) AS pc2 FROM c JOIN v ON feature = f GROUP BY vec_id""")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two component scores of all embeddings."""
    docs = table(spark, sf_dir, "embeddings")
    found = subspace.scores(docs, ["vec_id"], "embedding", subspace.principal_components(docs, "embedding", 2))
    return found.select("vec_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))

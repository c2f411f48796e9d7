"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def example(values: Sequence, number: Column) -> Column:
    """The value of a fixed list that a row's number leads to."""
    kind = "bigint" if any(isinstance(v, int) for v in values) else "string"
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (number % len(values) + 1).cast("int"))


def example_sql(values: Sequence, number: str) -> str:
    """The same in SQL."""
    return f"list_extract([{', '.join(map(literal, values))}], CAST({number} % {len(values)} + 1 AS INT))"



def betainc_cte(source: str, keys: str, steps: int = 200) -> str:
    """CTEs ``lentz`` and ``beta(keys, value)``: the regularised incomplete beta of (a, b, x) rows of ``source``.

    Lentz's continued fraction as a recursion; ``value`` is 0 or 1 at the borders.
    """
    return f"""
    lentz0 AS (
      SELECT {keys}, CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b, CAST(x AS DOUBLE) x, x >= (a + 1) / (a + b + 2) AS swap FROM {source} WHERE x > 0 AND x < 1
    ),
    lentz1 AS (SELECT {keys}, swap, CASE WHEN swap THEN b ELSE a END p, CASE WHEN swap THEN a ELSE b END q, CASE WHEN swap THEN 1 - x ELSE x END z FROM lentz0),
    lentz AS (
      SELECT {keys}, swap, p, q, z, 0 AS m, CAST(1 AS DOUBLE) c, 1 / (1 - (p + q) * z / (p + 1)) AS d, 1 / (1 - (p + q) * z / (p + 1)) AS h FROM lentz1
      UNION ALL
      SELECT {keys}, swap, p, q, z, m, c2, d2, h1 * d2 * c2 FROM (
        SELECT *, 1 / (1 + o * d1) AS d2, 1 + o / c1 AS c2 FROM (
          SELECT *, h * d1 * c1 AS h1, -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)) AS o FROM (
            SELECT *, 1 / (1 + e * d) AS d1, 1 + e / c AS c1 FROM (
              SELECT {keys}, swap, p, q, z, m + 1 AS m, c, d, h, CAST((m + 1) * (q - (m + 1)) * z / ((p + 2 * (m + 1) - 1) * (p + 2 * (m + 1))) AS DOUBLE) AS e FROM lentz WHERE m < {steps}
            )))))
    ,
    beta AS (
      SELECT {keys}, greatest(0.0, least(1.0, CASE WHEN swap THEN 1 - v ELSE v END)) AS value FROM (
        SELECT {keys}, swap, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(z) + q * ln(1 - z)) * h / p AS v FROM lentz WHERE m = {steps})
      UNION ALL SELECT {keys}, CASE WHEN x <= 0 THEN 0.0 ELSE 1.0 END FROM {source} WHERE x <= 0 OR x >= 1
    )"""


def t_pvalue(source: str, keys: str) -> str:
    """CTEs ending in ``tested``: ``source`` (keys, n, mean, sd) with the two-sided p of a paired t test."""
    on = " AND ".join(f"t.{k.strip()} = beta.{k.strip()}" for k in keys.split(","))
    return f"""
    tstat AS (SELECT *, mean / (sd / sqrt(n)) AS t FROM {source}),
    tbeta AS (SELECT {keys}, (n - 1) / 2.0 AS a, CAST(0.5 AS DOUBLE) AS b, (n - 1) / ((n - 1) + t * t) AS x FROM tstat WHERE n >= 2 AND sd > 0),
    {betainc_cte('tbeta', keys)},
    tested AS (
      SELECT t.*, CASE WHEN n < 2 THEN 1.0 WHEN coalesce(sd, 0) <= 0 THEN CASE WHEN abs(mean) < 1e-15 THEN 1.0 ELSE 1e-300 END
        ELSE least(1.0, greatest(1e-300, beta.value)) END AS p_value
      FROM tstat t LEFT JOIN beta ON {on}
    )"""


def bh(source: str, p: str = "p_value", by: str = "", out: str = "q_value") -> str:
    """A SELECT of ``source`` with q-values within ``by``."""
    part = f"PARTITION BY {by}, {p} IS NULL" if by else f"PARTITION BY {p} IS NULL"
    return f"""
      SELECT * EXCLUDE (bh_quotient), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(bh_quotient) OVER ({part} ORDER BY {p} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {out}
      FROM (SELECT *, {p} * count(*) OVER ({part}) / count(*) OVER ({part} ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bh_quotient FROM {source})"""

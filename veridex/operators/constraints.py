"""Fail-closed checks: each gives a table of violations, and ``enforce`` raises before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """Input breaks a contract."""


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def outside(df: DataFrame, column: str, allowed) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(column)


def failing(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false; unknown passes."""
    return df.filter(~F.coalesce(condition, F.lit(True)))


def missing_from(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def same_universe(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one side has, with the side's name; empty if the universes are equal."""
    only_left = missing_from(left, right, *keys).withColumn("side", F.lit("left_only"))
    return only_left.unionByName(missing_from(right, left, *keys).withColumn("side", F.lit("right_only")))


def enforce(violations: DataFrame, what: str, shown: int = 5) -> None:
    found = violations.take(shown)
    if found:
        raise ConstraintError(f"{what}: " + "; ".join(str(r.asDict()) for r in found))

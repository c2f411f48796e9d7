"""Partial aggregates that merge: exact counts and sums with sketches of distinct values and quantiles.

Partials are kept at a fine grouping and rolled up to any coarser one without reading rows again. An estimate never takes an
exact figure's place: ``checked`` puts both beside each other, with the error and whether it is within its bound.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the buckets of a distinct sketch, and size of a quantile sketch.
LOG_BUCKETS, QUANTILE_SIZE = 14, 400
#: Standard errors that an estimate of distinct values may be off by.
SIGMAS = 4.0


def distinct_error(log_buckets: int = LOG_BUCKETS) -> float:
    """Relative standard error of an estimate of distinct values."""
    return 1.04 / math.sqrt(1 << log_buckets)


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """By how much the rank of an estimated quantile may be off, with 99 percent confidence, as a share of the rows: the
    published figure of the sketch, 2.3 / size^0.9, doubled."""
    return 2 * 2.296 / size**0.9021


def partials(df: DataFrame, by: list[str], distinct: str, number: str) -> DataFrame:
    """(by..., n, known, total, distinct_sketch, quantile_sketch); NULLs are in n only, NaN counts as NULL."""
    x = F.when(~F.isnan(F.col(number).cast("double")), F.col(number).cast("double"))
    return df.withColumn("_x", x).groupBy(*by).agg(
        F.count("*").alias("n"), F.count("_x").alias("known"), F.coalesce(F.sum(F.col("_x").cast("decimal(28,6)")), F.lit(0).cast("decimal(38,6)")).alias("total"),
        F.hll_sketch_agg(distinct, F.lit(LOG_BUCKETS)).alias("distinct_sketch"), F.kll_sketch_agg_double("_x", F.lit(QUANTILE_SIZE)).alias("quantile_sketch"))


def rolled_up(parts: DataFrame, by: list[str]) -> DataFrame:
    """The same by fewer columns, or by none."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("total").alias("total"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def estimates(parts: DataFrame, by: list[str], at: float) -> DataFrame:
    """(by..., n, known, total, distinct, quantile): figures of a roll-up; a group without known numbers has no quantile."""
    quantile = F.when(F.col("known") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(at)))
    return parts.select(*by, "n", "known", "total", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), quantile.alias("quantile"))


def checked(df: DataFrame, parts: DataFrame, by: list[str], distinct: str, number: str, at: float) -> DataFrame:
    """Estimates of a roll-up beside what the rows say: exact_distinct, distinct_error, distinct_within; the share of known
    numbers up to the estimated quantile and whether ``at`` lies within rank_error of the ranks that it stands for."""
    told = estimates(rolled_up(parts, by), by, at)
    x = F.when(~F.isnan(F.col(number).cast("double")), F.col(number).cast("double"))
    quantile = told.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("quantile").alias("_q"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = df.withColumn("_x", x).join(quantile, same)
    exact = rows.groupBy(*by).agg(F.count_distinct(distinct).alias("exact_distinct"), (F.count_if(F.col("_x") <= F.col("_q")) / F.count("_x")).alias("rank_to"), (F.count_if(F.col("_x") < F.col("_q")) / F.count("_x")).alias("rank_from"))
    keyed = exact.select(*[F.col(c).alias(f"_{c}") for c in by], "exact_distinct", "rank_from", "rank_to")
    met = told.join(keyed, same)
    off = F.abs(F.col("distinct") - F.col("exact_distinct"))
    slack = rank_error()
    return met.select(
        *by, "n", "known", "total", "distinct", "exact_distinct", off.alias("distinct_error"), (off <= F.ceil(SIGMAS * distinct_error() * F.col("exact_distinct"))).alias("distinct_within"),
        "quantile", "rank_from", "rank_to", ((F.col("rank_from") - slack <= at) & (F.col("rank_to") + slack >= at)).alias("quantile_within"))

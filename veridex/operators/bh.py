"""Benjamini-Hochberg q-values, per stratum or over one stratum of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def adjust(df: DataFrame, p: str = "p_value", by=(), out: str = "q_value", floor: float | None = None) -> DataFrame:
    """q-values within each stratum ``by``; NULL and NaN p-values stay NULL and don't count.

    Ties get equal q-values, so no input order is needed. A filter that comes after stays above the window: adjust first,
    then select. For one huge stratum use :func:`adjust_global`.
    """
    clean = F.when(~F.isnan(F.col(p)), F.col(p))
    by = [F.col(c) if isinstance(c, str) else c for c in by]
    whole = Window.partitionBy(*by, clean.isNull())
    order = whole.orderBy(clean.asc_nulls_last())
    ranked = df.withColumn("_bh", F.when(clean.isNotNull(), clean * F.count(clean).over(whole) / F.count(clean).over(order.rangeBetween(Window.unboundedPreceding, 0))))
    # count over the range frame gives tied values the rank of their last: the smallest quotient among them
    # the minimum of all that follow, as a running one from the other end: Spark grows frames that start at the first row,
    # but computes frames that shrink anew for each row
    falling = whole.orderBy(clean.desc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    least = F.least(F.lit(1.0), F.min("_bh").over(falling))
    q = F.when(clean.isNotNull(), F.greatest(F.lit(floor), least) if floor is not None else least)
    return ranked.withColumn(out, q).drop("_bh")


def adjust_global(df: DataFrame, p: str = "p_value", out: str = "q_value") -> DataFrame:
    """q-values over all rows without a window in one task.

    Distinct p-values are counted with partial aggregation and range-partitioned; each partition's totals (one small row
    for each) give rank offsets, and each partition's least quotient gives the minimum of all that follow.
    """
    spark = df.sparkSession
    clean = F.when(~F.isnan(F.col(p)), F.col(p))
    counts = df.filter(clean.isNotNull()).groupBy(clean.alias("_p")).agg(F.count("*").alias("_n"))
    ranged = stage(counts.repartitionByRange("_p").withColumn("_part", F.spark_partition_id()), "p-values")
    sizes = {r._part: r.n for r in ranged.groupBy("_part").agg(F.sum("_n").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return df.withColumn(out, F.lit(None).cast("double"))
    before, at = [], 0
    for part in sorted(sizes):
        before.append((part, at))
        at += sizes[part]
    offsets = spark.createDataFrame(before, "_part int, _before bigint")
    inside = Window.partitionBy("_part").orderBy("_p")
    ranked = ranged.join(F.broadcast(offsets), "_part").withColumn("_quotient", F.col("_p") * float(total) / (F.col("_before") + F.sum("_n").over(inside)))
    least = {r._part: r.m for r in ranked.groupBy("_part").agg(F.min("_quotient").alias("m")).collect()}
    after, low = [], 1.0
    for part in sorted(least, reverse=True):
        after.append((part, low))
        low = min(low, least[part])
    following = spark.createDataFrame(after, "_part int, _after double")
    own = F.min("_quotient").over(Window.partitionBy("_part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    q = ranked.join(F.broadcast(following), "_part").select("_p", F.least(own, F.col("_after")).alias(out))
    return df.join(q, clean == F.col("_p"), "left").drop("_p")


def not_a_probability(p: Column) -> Column:
    """A violation marker: probabilities outside [0, 1]."""
    return p.isNotNull() & ~p.between(0.0, 1.0)

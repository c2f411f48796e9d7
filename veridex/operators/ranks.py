"""Ranks and row numbers over a whole table, without a window in one task.

Rows, or distinct values, are range-partitioned and staged; each partition's total, one small row on the driver, tells
where its numbers start; the numbers inside a partition come from a window over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

_PART, _BEFORE = "_part", "_before"
#: Distinct values of a group that one aggregation may hold: some 10 MB.
SMALL = 100_000


def _offsets(ranged: DataFrame, weight: Column) -> DataFrame:
    """``ranged`` with the weights of all partitions before a row's own."""
    sizes = {r[_PART]: r.n for r in ranged.groupBy(_PART).agg(F.sum(weight).alias("n")).collect()}
    before, at = [], 0
    for part in sorted(sizes):
        before.append((part, at))
        at += sizes[part]
    starts = ranged.sparkSession.createDataFrame(before, f"{_PART} int, {_BEFORE} bigint")
    return ranged.join(F.broadcast(starts), _PART)  # a row for each partition


def row_numbers(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Numbers from 1 in the order of ``order``, which should be unique."""
    names = [f"_order{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order)))
    ranged = stage(keyed.repartitionByRange(*names).withColumn(_PART, F.spark_partition_id()), "rows")
    inside = F.row_number().over(Window.partitionBy(_PART).orderBy(*names))
    return _offsets(ranged, F.lit(1)).withColumn(out, inside + F.col(_BEFORE)).drop(_PART, _BEFORE, *names)


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks from 1, equal values with the mean of theirs; NULL values have none. Distinct values are ranked, not rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = stage(counts.repartitionByRange("_v").withColumn(_PART, F.spark_partition_id()), "values")
    inside = F.sum("_n").over(Window.partitionBy(_PART).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = _offsets(ranged, F.col("_n")).select("_v", (F.col(_BEFORE) + inside - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def quantiles(df: DataFrame, by: list[str], column: str, at: list[float], out: str, small: int = SMALL) -> DataFrame:
    """The ``by`` columns and an array of exact quantiles, interpolated between neighbours as SQL's percentile does.

    Distinct values are counted with partial aggregation and range-partitioned by group and value, so a group of any size
    lies in many partitions, each of which knows how many values of its groups come before it. If no group has more than
    ``small`` distinct values, as counted first, they are aggregated group by group instead. NULL values don't count, a
    group of NULLs only has no row; NaN is over all numbers; NULL is a group like others.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    value = F.col(column).cast("double")
    counts = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], value.alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    counts = stage(counts, "counts")
    widest = counts.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if widest <= small:  # then a group's distinct values fit into one aggregation buffer, and the same result needs no sorting
        found = counts.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(q)) for q in at]), F.col("_n")).alias(out))
        return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], out)
    ranged = stage(counts.repartitionByRange(*keys, "_v").withColumn(_PART, F.spark_partition_id()), "values")
    # a group has a row for each partition that it reaches into
    sizes = ranged.groupBy(*keys, _PART).agg(F.sum("_n").alias("_size"))
    group = Window.partitionBy(*keys)
    placed = sizes.select(
        *[F.col(k).alias(f"{k}_p") for k in keys], F.col(_PART).alias("_part_p"), F.sum("_size").over(group).alias("_total"),
        (F.sum("_size").over(group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias(_BEFORE),
    )
    same = F.col(_PART) == F.col("_part_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_p"))
    inside = F.sum("_n").over(Window.partitionBy(_PART, *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    # a distinct value fills the places first to last of its sorted group
    spread = ranged.join(placed, same).withColumn("_last", F.col(_BEFORE) + inside - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    place = [F.lit(float(q)) * (F.col("_total") - 1) for q in at]
    pick = lambda p: F.max(F.when(p.between(F.col("_first"), F.col("_last")), F.col("_v")))
    ends = [e for i, p in enumerate(place) for e in (pick(F.floor(p)).alias(f"_low{i}"), pick(F.ceil(p)).alias(f"_high{i}"))]
    found = spread.groupBy(*keys, "_total").agg(*ends)
    between = [F.when(F.floor(p) == F.ceil(p), F.col(f"_low{i}")).otherwise((F.ceil(p) - p) * F.col(f"_low{i}") + (p - F.floor(p)) * F.col(f"_high{i}")) for i, p in enumerate(place)]
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.array(*between).alias(out))

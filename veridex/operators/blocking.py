"""Pairs of records that share a value, each pair once.

Records meet in the blocks of their values. A pair that shares several values belongs to the least of these blocks, by size
and then by value, which each row can tell from its own list of values: no pair arises twice and nothing is deduplicated
after the join. A block of more than TILE records is cut into tiles of TILE by TILE, dealt out like small blocks, so a value
that a third of all records share makes many equal tasks. Its pairs are still all pairs: ``sizes`` tells how many before they
are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Records of a tile's side. Small, so that tiles are many and tasks even.
TILE = 128
#: Earlier values of a record up to which totals come from groups, 2^8 of them for such a value.
DEEPEST = 8


def sizes(df: DataFrame, key: str, value: str) -> DataFrame:
    """(value, records, pairs) of the blocks with more than one record; repeated rows count once, NULL is no value."""
    own = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key), F.col(value)).distinct()
    n = F.col("records")
    return own.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("records")).filter(n > 1).withColumn("pairs", F.floor(n * (n - 1) / 2).cast("bigint"))


def _placed(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, records, earlier) of values that several records have; ``earlier`` are the record's blocks before this one."""
    own = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value")).distinct()
    records = own.groupBy("value").agg(F.count("*").alias("records")).filter("records > 1")
    mine = Window.partitionBy("key").orderBy("records", "value").rowsBetween(Window.unboundedPreceding, -1)
    return stage(own.join(records, "value").withColumn("earlier", F.collect_list("value").over(mine)), "blocks")


def shared_pairs(df: DataFrame, key: str, value: str, tile: int = TILE) -> DataFrame:
    """(left_key, right_key, block, block_records) of (key, value) rows: every unordered pair that shares a value, left < right.

    ``block`` is the least value of the pair by its number of records, then by itself. A record has as many values as fit into
    one row. Repeated rows count once; NULL keys and values make no pairs.
    """
    return _met(_placed(df, key, value), tile)


def _met(told: DataFrame, tile: int) -> DataFrame:
    chunks = F.ceil(F.col("records") / tile).cast("int")
    dealt = told.withColumn("chunk", F.pmod(F.xxhash64("key"), chunks).cast("int"))
    left = dealt.select("value", "records", F.col("chunk").alias("a"), F.explode(F.sequence("chunk", chunks - 1)).alias("b"), F.col("key").alias("_l"), F.col("earlier").alias("_le"))
    right = dealt.select("value", F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("a"), F.col("chunk").alias("b"), F.col("key").alias("_r"), F.col("earlier").alias("_re"))
    # merged: a small file says nothing of the copies that its rows make here, so it must not be broadcast
    met = left.join(right.hint("merge"), ["value", "a", "b"]).filter((F.col("a") < F.col("b")) | (F.col("_l") < F.col("_r"))).filter(~F.arrays_overlap("_le", "_re"))
    return met.select(F.least("_l", "_r").alias("left_key"), F.greatest("_l", "_r").alias("right_key"), F.col("value").alias("block"), F.col("records").alias("block_records"))


def shared_totals(df: DataFrame, key: str, value: str, deepest: int = DEEPEST) -> DataFrame:
    """(block, block_records, pairs, left_sum, right_sum) over what :func:`shared_pairs` gives, for whole-number keys: the pairs of
    each block, and the sums of their lesser and greater keys. No pairs are made.

    The pairs of a block that share no earlier value are all its pairs, less those that also share one of the earlier values,
    plus those that share two, and so on: each set of earlier values is a group, whose pairs and sums follow from its keys'
    ranks. Ranks come from range partitions, so a group may have any size. A record of m values is in 2^m - 1 groups; if one
    has more than ``deepest`` earlier values, the pairs are made and added up.
    """
    told = _placed(df, key, value)
    most = told.agg(F.max(F.size("earlier")).alias("n")).first().n or 0
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    if most > deepest:
        pairs = _met(told, TILE)
        return pairs.groupBy("block", "block_records").agg(F.count("*").alias("pairs"), F.sum(whole("left_key")).cast("decimal(38,0)").alias("left_sum"), F.sum(whole("right_key")).cast("decimal(38,0)").alias("right_sum"))
    none = F.array(F.array().cast(told.schema["earlier"].dataType))
    subsets = F.aggregate("earlier", none, lambda found, v: F.concat(found, F.transform(found, lambda s: F.concat(s, F.array(v)))))
    group = ["value", "records", "also"]
    spread = told.select("key", "value", "records", F.explode(subsets).alias("also"))
    ranged = stage(spread.repartitionByRange("value", "also", "key").withColumn("_part", F.spark_partition_id()), "groups")
    inside = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part", *group).orderBy("key")))
    # of each group and partition its keys, their sum, and their sum times the keys before them in the partition
    sums = inside.groupBy(*group, "_part").agg(F.count("*").alias("n"), F.sum(whole("key")).alias("s"), F.sum(whole("key") * (F.col("_rank") - 1).cast("decimal(12,0)")).cast("decimal(38,0)").alias("w"))
    over = Window.partitionBy(*group)
    placed = sums.withColumns({"_n": F.sum("n").over(over), "_before": F.sum("n").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")})
    count = lambda c: c.cast("decimal(12,0)")
    s = F.col("s").cast("decimal(26,0)")
    high = F.col("w") + s * count(F.col("_before"))
    parts = placed.withColumns({"_high": high, "_low": s * count(F.col("_n") - 1) - high})
    sign = F.when(F.size("also") % 2 == 0, 1).otherwise(-1)
    n = F.col("_n").cast("bigint")
    totals = parts.groupBy(*group).agg(F.shiftright(F.max(n * (n - 1)), 1).alias("pairs"), F.sum("_low").cast("decimal(38,0)").alias("low"), F.sum("_high").cast("decimal(38,0)").alias("high"))
    found = totals.groupBy(F.col("value").alias("block"), F.col("records").alias("block_records")).agg(
        F.sum(sign * F.col("pairs")).alias("pairs"), F.sum(sign * F.col("low")).cast("decimal(38,0)").alias("left_sum"), F.sum(sign * F.col("high")).cast("decimal(38,0)").alias("right_sum"))
    return found.filter("pairs > 0")

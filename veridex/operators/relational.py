"""Joins, set operations, aggregates, ranking and grids as the evidence pipelines use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocking import shared_pairs
from .constraints import duplicates, enforce, same_universe

#: Rows up to which a dimension may be broadcast; a larger one is left to the planner.
DIMENSION_ROWS = 500_000
#: Column values of a complete grid.
GRID_COLUMNS = 10_000


def dimension(df: DataFrame, rows: int = DIMENSION_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a bounded count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def left_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that refuses a right side with repeated keys."""
    enforce(duplicates(right, *keys), "the right side repeats a key")
    return left.join(right, keys, "left")


def one_to_many(left: DataFrame, right: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Each left row with an ordered array of its right rows; an empty array where there are none.

    The array is the result, so a key's right rows must fit into one row; a plain join has no such bound.
    """
    struct = F.struct(*order, *[c for c in right.columns if c not in (*order, key)])
    grouped = right.groupBy(key).agg(F.array_sort(F.collect_list(struct)).alias(out))
    return left.join(grouped, key, "left").withColumn(out, F.coalesce(out, F.filter(F.array(F.lit(None).cast(grouped.schema[out].dataType.elementType)), lambda _: F.lit(False))))


def unambiguous_dimension(dim: DataFrame, key: str, identity: str) -> DataFrame:
    """Rows of a lookup whose key leads to one identity only; ambiguous keys go before any join."""
    found = dim.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count_distinct(identity).alias("_n"), *[F.min_by(c, identity).alias(c) for c in dim.columns if c != key])
    return found.filter("_n = 1").drop("_n")


def first_dimension(dim: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in dim.columns if c != key]
    return dim.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def annotate(df: DataFrame, by_id: DataFrame, by_name: DataFrame, id_column: str, name_column: str, label: str) -> DataFrame:
    """A label by id, else by name, with its basis and whether both disagree. Both lookups have unique keys."""
    ids = by_id.select(F.col(id_column), F.col(label).alias("_by_id"))
    names = by_name.select(F.col(name_column), F.col(label).alias("_by_name"))
    out = df.join(ids, id_column, "left").join(names, name_column, "left")
    basis = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_name").isNotNull(), "name").otherwise("unresolved")
    conflict = F.col("_by_id").isNotNull() & F.col("_by_name").isNotNull() & (F.col("_by_id") != F.col("_by_name"))
    return out.withColumn(label, F.coalesce("_by_id", "_by_name")).withColumn("basis", basis).withColumn("conflict", conflict).drop("_by_id", "_by_name")


def union_of_keys(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with presence flags; columns of both sides keep prefixes ``p_`` and ``g_``."""
    p = predicted.select(*keys, *[F.col(c).alias(f"p_{c}") for c in predicted.columns if c not in keys], F.lit(True).alias("in_predicted"))
    g = gold.select(*keys, *[F.col(c).alias(f"g_{c}") for c in gold.columns if c not in keys], F.lit(True).alias("in_gold"))
    return p.join(g, keys, "full_outer").withColumn("in_predicted", F.coalesce("in_predicted", F.lit(False))).withColumn("in_gold", F.coalesce("in_gold", F.lit(False)))


def exact_universe(left: DataFrame, right: DataFrame, keys: list[str], metrics) -> tuple[DataFrame, DataFrame]:
    """(metrics, differing keys): the metrics are computed if both sides have equal keys, else they are NULL: blocked."""
    differing = same_universe(left, right, *keys)
    joined = left.alias("l").join(right.alias("r"), keys, "inner").agg(*metrics)
    if differing.isEmpty():
        return joined.withColumn("status", F.lit("compared")), differing
    return joined.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in joined.schema]).withColumn("status", F.lit("blocked")), differing


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """Counts and percent of all rows, NULL groups kept. The total is a window over the groups, not over rows."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def top_with_other(df: DataFrame, column: str, k: int, other: str = "other") -> DataFrame:
    """The k most frequent values by count and name; the rest is one row with the number of values in it."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k).select(F.col(column).alias("_c"))
    marked = counts.join(F.broadcast(top), F.col(column).eqNullSafe(F.col("_c")), "left")
    label = F.when(F.col("_c").isNotNull(), F.col(column)).otherwise(F.lit(other))
    return marked.groupBy(label.alias(column)).agg(F.sum("n").alias("n"), F.count("*").alias("members"))


def most_common(x: str, order: str) -> Column:
    """Over (value, count, first order) rows: the value of highest count, the earliest of ties."""
    return F.max_by(F.col(x), F.struct(F.col("n"), -F.col(order)))


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, and all rows whose first key is blank."""
    key = F.col(keys[0])
    blank = key.isNull() | (key.cast("string") == "")
    rank = F.row_number().over(Window.partitionBy(*keys, blank).orderBy(*order))
    return df.withColumn("_r", rank).filter((F.col("_r") == 1) | blank).drop("_r")


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def complete_grid(cells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Every row value with every column value, joined with what was measured. Both sides are display dimensions: the
    product is the size of the result. Over GRID_COLUMNS column values there is no such grid, and it is refused."""
    wide = columns.distinct()
    enforce(wide.agg(F.count("*").alias("column_values")).filter(F.col("column_values") > GRID_COLUMNS), "too many column values for a grid")
    grid = rows.distinct().join(F.broadcast(wide))
    return grid.join(cells, [*rows.columns, *columns.columns], "left")


def presence(df: DataFrame, key: str, spaces: dict[str, DataFrame]) -> DataFrame:
    """0/1 columns that tell in which spaces a key occurs."""
    out = df.select(key).distinct()
    for name, space in spaces.items():
        out = out.join(space.select(key).distinct().withColumn(f"in_{name}", F.lit(1)), key, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(0)))
    return out


def symmetric_difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return same_universe(left, right, *keys)


def pairs_by_shared(df: DataFrame, key: str, shared: str) -> DataFrame:
    """Unordered pairs of keys that share a value: candidates from blocks, see blocking.py, instead of all pairs."""
    return shared_pairs(df, key, shared).select("left_key", "right_key")


def best_candidate(df: DataFrame, keys: list[str], kind: str, score: str, index: str, priorities: dict[str, int]) -> DataFrame:
    """One row of each key: of the kind of highest priority, then of the highest score, then the first by index. A kind
    without a priority has 0, a NULL score is under all others."""
    place = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in priorities.items()], F.lit(0))
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(place, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))), -F.col(index))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def precursors(df: DataFrame, names: list[str], tissues: list[str], numbers: list[str], name: str = "refmet_name", tissue: str = "tissue") -> DataFrame:
    """Rows of listed names in listed tissues, in any case; what is no number in the number columns is NULL."""
    low = lambda c, wanted: F.lower(F.col(c).cast("string")).isin(*wanted)
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    return df.filter(low(name, names) & low(tissue, tissues)).withColumns({c: number(c) for c in numbers})


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns: rows are counted by all of them first, so each is taken apart once a combination."""
    kept = df.groupBy(*columns).agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return kept.select("n", cells).groupBy("x.field", "x.value").agg(F.sum("n").alias("n"))


def ranked(df: DataFrame, by: list[str], order, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))


def unpivot(row: DataFrame, keys: list[str], names: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return row.unpivot([F.col(k) for k in keys], [F.col(n) for n in names], name, value)

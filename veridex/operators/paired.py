"""Paired before/after differential analysis: pairs by conditional aggregation, one shuffle, then statistics per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .bh import adjust


def pairs(df: DataFrame, keys: list[str], participant: str, is_before: Column, is_after: Column, value: str, combine=F.avg) -> DataFrame:
    """One row per keys and participant with ``before`` and ``after``; a side without values is NULL, both where no row is on a side."""
    v = F.col(value)
    return df.groupBy(*keys, participant).agg(combine(F.when(is_before, v)).alias("before"), combine(F.when(is_after, v)).alias("after"))


def with_change(paired: DataFrame, exact: bool = False) -> DataFrame:
    """``log2fc`` of complete positive pairs, NULL for others. ``exact`` keeps changes between neighbouring doubles."""
    ok = (F.col("before") > 0) & (F.col("after") > 0)
    plain = F.when(ok, F.log2(F.col("after") / F.col("before")))
    return paired.withColumn("log2fc", stats.log2_change(F.col("before"), F.col("after")) if exact else plain)


def single_label(c: str) -> Column:
    """An aggregate: the only value of a group that isn't blank, '' where there are none or several."""
    filled = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return F.when(F.min(filled) == F.max(filled), F.min(filled)).otherwise("")


def effects(changes: DataFrame, keys: list[str], min_pairs: int = 1, floor: float = stats.FLOOR, labels: tuple[str, ...] = ()) -> DataFrame:
    """Per group: n_pairs, mean_log2fc, mean_pre, mean_post, p_value. Groups under ``min_pairs`` are left out. Of each label
    column a group has the value that all its complete pairs share."""
    found = changes.filter("log2fc is not null").groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.avg("log2fc").alias("mean_log2fc"), F.stddev_samp("log2fc").alias("_sd"), F.avg("before").alias("mean_pre"), F.avg("after").alias("mean_post"),
        *[single_label(c).alias(c) for c in labels],
    )
    found = found.filter(F.col("n_pairs") >= min_pairs)
    return found.withColumn("p_value", stats.paired_t_p(F.col("n_pairs"), F.col("mean_log2fc"), F.coalesce("_sd", F.lit(0.0)), floor)).drop("_sd")


def strata(df: DataFrame, column: str, out: str = "stratum", everyone: str = "all") -> DataFrame:
    """Each row once for all and once for its own stratum; rows without one are only in all."""
    return df.withColumn(out, F.explode(F.array_compact(F.array(F.lit(everyone), F.col(column)))))


def selection(fdr: Column, effect: Column, alpha: float = 0.05, threshold: float = 0.0) -> Column:
    """not_testable, higher, lower, significant_below_threshold or not_selected."""
    return (
        F.when(fdr.isNull() | effect.isNull(), F.lit("not_testable"))
        .when((fdr <= alpha) & (effect >= threshold) & (effect > 0), F.lit("higher"))
        .when((fdr <= alpha) & (effect <= -threshold) & (effect < 0), F.lit("lower"))
        .when(fdr <= alpha, F.lit("significant_below_threshold"))
        .otherwise(F.lit("not_selected"))
    )


def direction(effect: Column) -> Column:
    return F.when(effect > 0, F.lit("up")).when(effect < 0, F.lit("down")).when(effect == 0, F.lit("no_change")).otherwise(F.lit("orientation_unknown"))


#: Display order of selections.
SELECTION_ORDER = ("higher", "lower", "significant_below_threshold", "not_selected", "not_testable")


def display_order(df: DataFrame, by=(), status: str = "selection", fdr: str = "q_value", effect: str = "mean_log2fc", key: str = "feature", out: str = "display_rank") -> DataFrame:
    """Number rows by selection, q (unknown last), size of effect (unknown last) and key."""
    priority = F.array_position(F.array(*[F.lit(s) for s in SELECTION_ORDER]), F.col(status))
    w = Window.partitionBy(*by).orderBy(priority, F.col(fdr).asc_nulls_last(), F.abs(F.col(effect)).desc_nulls_last(), F.lower(F.col(key)), F.col(key))
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def between_groups(effects_: DataFrame, keys: list[str], group: str, order: str, pairs_=(("EE", "CON"), ("RE", "CON"), ("EE", "RE"))) -> DataFrame:
    """Derived group contrasts: effect difference, and the larger p and q of the two: a label, not an inference.

    Of several rows of a key and group the last by ``order`` counts. One aggregation, no self-join.
    """
    pick = {g: F.max_by(F.when(F.col(group) == g, F.struct("mean_log2fc", "p_value", "q_value")), F.when(F.col(group) == g, F.col(order))) for p in pairs_ for g in p}
    wide = effects_.groupBy(*keys).agg(*[c.alias(f"_{g}") for g, c in pick.items()])
    made = [
        F.when(F.col(f"_{a}").isNotNull() & F.col(f"_{b}").isNotNull(), F.struct(
            F.lit(f"{a}-{b}").alias("contrast"),
            F.round(F.col(f"_{a}.mean_log2fc") - F.col(f"_{b}.mean_log2fc"), 12).alias("effect_difference"),
            F.greatest(f"_{a}.p_value", f"_{b}.p_value").alias("p_max"),
            F.greatest(f"_{a}.q_value", f"_{b}.q_value").alias("q_max"),
        ))
        for a, b in pairs_
    ]
    return wide.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("c")).select(*keys, "c.*").withColumn("is_inference", F.lit(False))


def unambiguous(df: DataFrame, contrast: list[str], key: str) -> DataFrame:
    """Rows whose key occurs once in its contrast; blank keys go."""
    return df.filter(F.col(key) != "").withColumn("_n", F.count("*").over(Window.partitionBy(*contrast, key))).filter("_n = 1").drop("_n")


def ambiguous_count(df: DataFrame, contrast: list[str], key: str) -> DataFrame:
    found = df.filter(F.col(key) != "").groupBy(*contrast, key).agg(F.count("*").alias("n"))
    return found.groupBy(*contrast).agg(F.count_if(F.col("n") > 1).alias("ambiguous_keys"))


def similarity(left: DataFrame, right: DataFrame, left_contrast: str, right_contrast: str, key: str, effect: str, least: int = 5) -> DataFrame:
    """Contrast pairs with ``least`` shared keys or more: an equi-join on the key, grouped by pair; never a cross join.

    score = .45 max(r, 0) + .35 concordance + .20 min(n / 25, 1); concordance counts pairs of strictly equal sign.
    """
    l = left.select(F.col(left_contrast).alias("left_contrast"), F.col(key).alias("_k"), F.col(effect).alias("_x"))  # noqa: E741
    r = right.select(F.col(right_contrast).alias("right_contrast"), F.col(key).alias("_k"), F.col(effect).alias("_y"))
    l, r = unambiguous(l, ["left_contrast"], "_k"), unambiguous(r, ["right_contrast"], "_k")  # noqa: E741
    both = l.join(r, "_k").filter("_x is not null and _y is not null")
    found = both.groupBy("left_contrast", "right_contrast").agg(
        F.count("*").alias("n_overlap"), stats.pearson(F.col("_x"), F.col("_y")).alias("pearson_r"), F.avg(F.when(F.col("_x") * F.col("_y") > 0, 1.0).otherwise(0.0)).alias("concordance")
    ).filter(F.col("n_overlap") >= least)
    score = 0.45 * F.greatest(F.col("pearson_r"), F.lit(0.0)) + 0.35 * F.col("concordance") + 0.20 * F.least(F.col("n_overlap") / 25, F.lit(1.0))
    return found.withColumn("score", score)


def overlap_report(left: DataFrame, right: DataFrame, left_contrast: str, right_contrast: str, key: str, least: int = 5) -> DataFrame:
    """For contrast pairs with ``least`` shared unambiguous keys or more: n_overlap, the ambiguous keys of each side, and how many
    keys that both have were left out because they are ambiguous on a side, with their names in order."""

    def counted(df: DataFrame, contrast: str, name: str) -> DataFrame:
        n = df.filter(F.col(key) != "").groupBy(F.col(contrast).alias(name), F.col(key).alias("_k")).agg((F.count("*") > 1).alias(f"_{name}"))
        return n

    l, r = counted(left, left_contrast, "left_contrast"), counted(right, right_contrast, "right_contrast")  # noqa: E741
    odd = lambda df, name: df.groupBy(name).agg(F.count_if(f"_{name}").alias(f"{name.split('_')[0]}_ambiguous"))
    either = F.col("_left_contrast") | F.col("_right_contrast")
    met = l.join(r, "_k").groupBy("left_contrast", "right_contrast").agg(F.count_if(~either).alias("n_overlap"), F.count_if(either).alias("excluded_overlap"), F.array_join(F.array_sort(F.collect_list(F.when(either, F.col("_k")))), ";").alias("excluded_keys"))
    return met.filter(F.col("n_overlap") >= least).join(odd(l, "left_contrast"), "left_contrast").join(odd(r, "right_contrast"), "right_contrast")


def reference_contrast(ranked: DataFrame, requested: str | None = None, contrasts: DataFrame | None = None) -> str | None:
    """The requested left contrast (it must exist), else that of the best pair, else the first of all ``contrasts``, else None."""
    if requested is not None:
        if ranked.filter(F.col("left_contrast") == requested).isEmpty():
            raise ValueError(f"no contrast {requested!r}")
        return requested
    best = ranked.orderBy(F.desc("score"), F.desc("n_overlap"), F.desc("left_contrast"), F.desc("right_contrast")).first()
    if best is None and contrasts is not None:
        return contrasts.agg(F.min("left_contrast")).first()[0]
    return best.left_contrast if best else None


def reference_rows(ranked: DataFrame, requested: Column | None = None, contrasts: DataFrame | None = None) -> DataFrame:
    """The same as one row of a plan: (left_contrast), NULL where there is no contrast, or not the requested one."""
    if requested is not None:
        return ranked.agg(F.max(F.when(F.col("left_contrast") == requested, F.col("left_contrast"))).alias("left_contrast"))
    order = F.struct("score", "n_overlap", "left_contrast", "right_contrast")
    best = ranked.agg(F.max_by("left_contrast", order).alias("left_contrast"))
    if contrasts is None:
        return best
    first = contrasts.agg(F.min("left_contrast").alias("_first"))
    return best.join(F.broadcast(first)).select(F.coalesce("left_contrast", "_first").alias("left_contrast"))  # one row each

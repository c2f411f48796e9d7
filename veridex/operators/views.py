"""Plot-ready tables: effect grids, trajectories, hierarchy roll-ups, enrichment. Tables only; drawing is not an operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.collections import compact, when_flag
from ..functions.kernels import fisher_right_p
from ..functions.stats import ratio
from .bh import adjust
from .constraints import enforce
from .ranks import quantiles
from .relational import complete_grid

#: Statuses that count as reviewed.
ACCEPTED_MAPPING = ("accepted", "exact", "curated", "not_required")
ACCEPTED_ANNOTATION = ("accepted", "accepted_curated", "curated")
HIGH_FRACTION = 0.20
QUARTILES = [0.25, 0.5, 0.75]


def quality_flags(missing_fraction: Column, below_lod_fraction: Column, limit: float = HIGH_FRACTION) -> Column:
    """high_* over the limit, *_not_reported for unknown: never silently fine."""
    return compact(
        F.when(missing_fraction.isNull(), F.lit("missingness_not_reported")).when(missing_fraction > limit, F.lit("high_missingness")),
        F.when(below_lod_fraction.isNull(), F.lit("below_lod_not_reported")).when(below_lod_fraction > limit, F.lit("high_below_lod")),
    )


def heatmap(cells: DataFrame, feature: str, contrast: str, effect: str, several_datasets: bool = False) -> DataFrame:
    """The full feature x contrast grid. Cells that were not measured are ``not_reported``; with several datasets, cells of
    unreviewed mappings have no value. Reads mapping_status, canonical_feature_id and the two fractions."""
    reviewed = F.col("canonical_feature_id").isNotNull() & F.col("mapping_status").isin(*ACCEPTED_MAPPING)
    closed = F.lit(several_datasets) & ~F.coalesce(reviewed, F.lit(False))
    grid = complete_grid(cells.withColumn("_here", F.lit(True)), cells.select(feature), cells.select(contrast))
    status = (
        F.when(F.col("_here").isNull(), "not_reported").when(closed, "unreviewed_harmonization").when(F.col(effect).isNull(), "effect_not_reported")
        .when(F.col("missing_fraction") > HIGH_FRACTION, "high_missingness").when(F.col("below_lod_fraction") > HIGH_FRACTION, "high_below_lod").otherwise("observed")
    )
    return grid.select(feature, contrast, status.alias("cell_status"), F.when(~closed, F.col(effect)).alias("value"))


def _with_quartiles(found: DataFrame, rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``found``, one row a group, with the exact quartiles ``_q`` of ``value`` over ``rows``, groups of any size."""
    q = quantiles(rows, by, value, QUARTILES, "_q").select(*[F.col(c).alias(f"{c}_q") for c in by], "_q")
    same = reduce(lambda a, b: a & b, [found[c].eqNullSafe(q[f"{c}_q"]) for c in by])
    return found.join(q, same, "left").drop(*[f"{c}_q" for c in by])


def trajectory(df: DataFrame, group: str, timepoint: str, value: str, lod: Column, flagged: Column, exclude_flagged: bool = True) -> DataFrame:
    """Per group and timepoint of the full grid: n, missing, below LOD, mean, sd, se, quartiles. Nothing is imputed.

    Values under the limit stay in n; ``exclude_flagged`` keeps them out of the statistics.
    """
    low = F.coalesce(flagged, F.lit(False)) | F.coalesce(F.col(value) < lod, F.lit(False))
    used = F.when(~low, F.col(value)) if exclude_flagged else F.col(value)
    marked = df.withColumn("_low", low).withColumn("_used", used)
    found = marked.groupBy(group, timepoint).agg(
        F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.count_if("_low").alias("n_below_lod"), F.count("_used").alias("n_used"),
        F.avg("_used").alias("mean"), F.stddev_samp("_used").alias("sd"),
    )
    grid = complete_grid(_with_quartiles(found, marked, [group, timepoint], "_used"), df.select(group), df.select(timepoint))
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return grid.select(
        group, timepoint, none("n"), none("n_missing"), none("n_below_lod"), none("n_used"), "mean", "sd", (F.col("sd") / F.sqrt("n_used")).alias("se"), F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"),
        F.array_join(compact(when_flag(F.col("n_missing") / F.col("n") > HIGH_FRACTION, "high_missingness"), when_flag(F.col("n_below_lod") / F.col("n") > HIGH_FRACTION, "high_below_lod")), ";").alias("flags"),
    )


def hierarchy(rows: DataFrame, levels: list[str], contrast: str, effect: str, significant: Column, expected: DataFrame | None = None, min_features: int = 3, min_coverage: float = 0.5) -> DataFrame:
    """Roll-ups of all levels in one pass: each row is exploded into its categories, then grouped once.

    Exclusions are counted in a fixed order: mapping, annotation, missingness, LOD, no effect. ``expected`` has
    (level, category, expected) sizes of the universe.
    """
    why = (
        F.when(~F.coalesce(F.col("mapping_status").isin(*ACCEPTED_MAPPING), F.lit(False)), "mapping").when(~F.coalesce(F.col("annotation_status").isin(*ACCEPTED_ANNOTATION), F.lit(False)), "annotation")
        .when(F.col("missing_fraction") > HIGH_FRACTION, "missingness").when(F.col("below_lod_fraction") > HIGH_FRACTION, "lod").when(F.col(effect).isNull(), "no_effect")
    )
    places = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(lv).cast("string").alias("category")) for lv in levels])
    long = rows.withColumn("_why", why).withColumn("_e", F.when(F.col("_why").isNull(), F.col(effect))).withColumn("_s", significant & F.col("_e").isNotNull()).withColumn("_p", F.explode(places)).filter("_p.category is not null")
    long = long.select(F.col("_p.level").alias("level"), F.col("_p.category").alias("category"), contrast, "_why", "_e", "_s")
    counters = [F.count_if(F.col("_why") == w).alias(f"excluded_{w}") for w in ("mapping", "annotation", "missingness", "lod", "no_effect")]
    found = long.groupBy("level", "category", contrast).agg(
        F.count("_e").alias("observed"), F.count_if(F.col("_e") > 0).alias("up"), F.count_if(F.col("_e") < 0).alias("down"), F.count_if("_s").alias("significant"), *counters
    )
    sizes = expected if expected is not None else found.select("level", "category").distinct().withColumn("expected", F.lit(None).cast("bigint"))
    out = _with_quartiles(found, long, ["level", "category", contrast], "_e").join(sizes, ["level", "category"], "left")
    coverage = ratio(F.col("observed"), F.col("expected"))
    status = F.when(F.col("observed") < min_features, "insufficient_feature_count").when(F.col("expected").isNull(), "coverage_denominator_unknown").when(coverage < min_coverage, "insufficient_coverage").otherwise("eligible_descriptive_summary")
    return out.select(
        "level", "category", contrast, "observed", "expected", coverage.alias("coverage"), F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "up", "down",
        ratio(F.greatest("up", "down"), F.col("up") + F.col("down")).alias("sign_concordance"), ratio(F.col("significant"), F.col("observed")).alias("significant_fraction"), *[F.col(f"excluded_{w}") for w in ("mapping", "annotation", "missingness", "lod", "no_effect")], status.alias("status"),
    )


def enrichment(rows: DataFrame, stratum: str, label: str, significant: Column, effect: str, p: str, name: str, examples: int = 8) -> DataFrame:
    """Per stratum and class: right-tail hypergeometric enrichment against the stratum, q over all its classes.

    Rows without a class are no part of the universe. Select labels afterwards: the window must see all classes.
    Background counts come from the class counts, so rows are shuffled once, pre-aggregated.
    """
    flagged = rows.filter(F.col(label).isNotNull() & (F.trim(label) != "")).withColumn("_s", F.coalesce(significant, F.lit(False)))
    # the first examples of a class are found by a window that keeps as many in each task, never all
    first = Window.partitionBy(stratum, label).orderBy("_p", "_name")
    named = flagged.filter("_s").select(stratum, label, F.col(p).alias("_p"), F.col(name).alias("_name")).distinct().withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= examples)
    shown = named.groupBy(stratum, label).agg(F.array_sort(F.collect_list(F.struct("_p", "_name"))).alias("_examples"))
    by = flagged.groupBy(stratum, label).agg(
        F.count("*").alias("class_rows"), F.count_if("_s").alias("class_significant"), F.count_if(F.col("_s") & (F.col(effect) > 0)).alias("up_significant"), F.count_if(F.col("_s") & (F.col(effect) < 0)).alias("down_significant"),
    )
    total = by.groupBy(stratum).agg(F.sum("class_rows").alias("background_rows"), F.sum("class_significant").alias("background_significant"))
    out = by.join(total, stratum)
    share = ratio(F.col("background_significant"), F.col("background_rows"))
    out = out.withColumn("enrichment_ratio", F.when(share > 0, (F.col("class_significant") / F.col("class_rows")) / share)).withColumn("p_value", fisher_right_p(F.col("class_significant"), F.col("class_rows"), F.col("background_significant"), F.col("background_rows")))
    names = F.array_join(F.transform("_examples", lambda e: e["_name"]), ";")
    out = adjust(out, by=[stratum]).join(shown, [stratum, label], "left").withColumn("examples", F.coalesce(names, F.lit("")))
    flags = compact(when_flag(F.col("class_rows") < 3, "fewer_than_three_rows"), when_flag(F.col("background_significant") == 0, "no_significant_rows"))
    return out.withColumn("significant", F.col("q_value") < 0.05).withColumn("flags", F.array_join(flags, ";")).drop("_examples")


def match_search(rows: DataFrame, query_id: str, query_name: str, id_column: str, names: list[str]) -> DataFrame:
    """Rows that match a search: exact id, else exact name, else substring; ``match_kind`` tells which."""
    low = [F.lower(F.trim(F.col(n))) for n in names]
    exact = reduce(lambda a, b: a | b, [n == query_name.lower() for n in low])
    inside = reduce(lambda a, b: a | b, [F.contains(n, F.lit(query_name.lower())) for n in low])
    kind = F.when(F.col(id_column) == query_id, "exact_id").when(exact, "exact_name").when(inside, "substring")
    return rows.withColumn("match_kind", kind).filter("match_kind is not null")


# What a view says of intervals that no source reports, and of its inference.
NO_INTERVAL, INFERENCE = "not_reported; no interval inferred by plotting layer", "feature-level source model; no cross-contrast pooling"


def interval_violations(rows: DataFrame) -> DataFrame:
    """Rows with half an interval, or with one whose ends are the wrong way round."""
    low, high = F.col("ci_low"), F.col("ci_high")
    why = F.when(low.isNull() != high.isNull(), "half_interval").when(low > high, "ends_reversed")
    return rows.withColumn("violation", why).filter("violation is not null")


def single_feature(rows: DataFrame, contrasts: DataFrame, feature: str) -> DataFrame:
    """One feature's effects in the display order of their contrasts, intervals as their source reports them. The feature is a
    row's canonical id, or its own where it has none. Rows of one contrast and id follow by falling effect, then by
    interval. Rows whose interval is broken stop the view."""
    own = F.coalesce(F.nullif(F.trim("canonical_feature_id"), F.lit("")), F.col("feature_id"))
    chosen = rows.filter(own == feature)
    enforce(interval_violations(chosen).select("feature_id", "contrast_id", "violation"), "broken intervals")
    met = chosen.join(contrasts.select("contrast_id", "display_order"), "contrast_id")
    said = F.coalesce(F.nullif(F.trim("ci_semantics"), F.lit("")), F.lit(NO_INTERVAL))
    rest = [F.desc(c) if c == "effect" else F.col(c) for c in ("effect", "ci_low", "ci_high", "ci_semantics") if c in rows.columns]
    order = F.row_number().over(Window.orderBy("display_order", "contrast_id", "feature_id", *rest))  # a row for each contrast
    return met.withColumns({"ci_semantics": said, "single_feature_inference": F.lit(INFERENCE), "contrast_order": order})


# The fields of an analysis stratum, in order.
STRATUM_FIELDS = ("source_system", "study_id", "species", "sample_matrix", "assay_panel", "accession_or_contrast", "sex_or_subgroup")


def stratum_value(fields: dict[str, Column]) -> Column:
    """``field=value`` of all seven fields; one that is blank, or isn't given, is not_reported."""
    value = lambda f: F.coalesce(F.nullif(F.trim(F.regexp_replace(fields[f].cast("string"), r"\s+", " ")), F.lit("")), F.lit("not_reported")) if f in fields else F.lit("not_reported")
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{f}="), value(f)) for f in STRATUM_FIELDS])


def mixed_strata(rows: DataFrame, stratum: str, columns: list[str]) -> DataFrame:
    """(stratum, column, values) of strata in which a column has several values, or none, where one is required."""
    counts = rows.groupBy(stratum).agg(*[F.count_distinct(c).alias(c) for c in columns])
    long = counts.select(stratum, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns])).alias("x")).select(stratum, "x.*")
    return long.filter("values <> 1")

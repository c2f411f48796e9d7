"""The corpus snapshot: bulk indexes of a repository as seven tables with one summary of counts.

Each index has a ``position``, the order in which its rows came. Of rows that share an identifier the first counts and the
others are counted as removed; rows without one all stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles

# What an analysis's text says of its kind, and the names of kinds, bases and categories.
UNTARGETED, TARGETED = r"(?U)\b(untargeted|un-targeted|non-targeted)\b", r"(?U)\btargeted\b"
BY_INDEX, BY_TEXT, LOWER_BOUND, NO_LABEL = "Metabolomics Workbench untarg_studies index", "analysis text label", "analysis text label; lower bound", "no explicit targeted/untargeted label"


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def first_rows(df: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """The first row of each key, and every row whose keys are all blank; combined before the shuffle."""
    blank = _blank(keys[0])
    for k in keys[1:]:
        blank = blank & _blank(k)
    rest = [c for c in df.columns if c not in keys]
    named = df.filter(~blank).groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_r")).select(*keys, "_r.*")
    return named.select(df.columns).unionByName(df.filter(blank))


def classified(analyses: DataFrame, untargeted: DataFrame) -> DataFrame:
    """Analyses with assay_scope and its basis: the index of untargeted ones first, then what their text says."""
    index = untargeted.select(F.trim("analysis_id").alias("_id")).filter("_id is not null and _id <> ''").distinct().withColumn("_in", F.lit(True))
    text = F.lower(F.concat_ws(" ", "analysis_summary", "analysis_display", "analysis_type"))
    found = analyses.join(index, F.trim("analysis_id") == F.col("_id"), "left")
    scope = F.when(F.col("_in"), "explicit_untargeted").when(text.rlike(UNTARGETED), "explicit_untargeted").when(text.rlike(TARGETED), "explicit_targeted").otherwise("unclassified_or_other")
    basis = F.when(F.col("_in"), BY_INDEX).when(text.rlike(UNTARGETED), BY_TEXT).when(text.rlike(TARGETED), LOWER_BOUND).otherwise(NO_LABEL)
    return found.withColumn("assay_scope", scope).withColumn("assay_scope_basis", basis).drop("_id", "_in")


def study_scopes(summaries: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per study with a summary: which kinds its analyses have, its category and how many they are."""
    by = analyses.groupBy(F.trim(F.coalesce("study_id", F.lit(""))).alias("study_id")).agg(*[F.bool_or(F.col("assay_scope") == s).alias(n) for s, n in (("explicit_targeted", "t"), ("explicit_untargeted", "u"))], F.count("*").alias("analysis_count"))
    studies = summaries.filter(~_blank("study_id")).select("study_id").distinct()
    t, u = F.coalesce("t", F.lit(False)), F.coalesce("u", F.lit(False))
    category = F.when(t & u, "both_explicit").when(t, "targeted_explicit_only").when(u, "untargeted_explicit_only").otherwise("neither_explicit_or_no_analysis")
    return studies.join(by, "study_id", "left").select("study_id", t.alias("has_explicit_targeted_analysis"), u.alias("has_explicit_untargeted_analysis"), category.alias("study_assay_category"), F.coalesce("analysis_count", F.lit(0).cast("bigint")).alias("analysis_count"))


def _or_unknown(c: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown"))


def species_distribution(species: DataFrame) -> DataFrame:
    """Per Latin name: its common names, its studies, and their percent of the studies that have a species."""
    own = species.select(F.trim(F.coalesce("study_id", F.lit(""))).alias("study_id"), _or_unknown("latin_name").alias("latin_name"), _or_unknown("common_name").alias("common_name"))
    by = own.select("study_id", "latin_name").distinct().groupBy("latin_name").agg(F.count("*").alias("study_count"))
    names = own.select("latin_name", "common_name").distinct().groupBy("latin_name").agg(F.array_join(F.array_sort(F.collect_list("common_name")), "; ").alias("common_names"))
    total = own.agg(F.count_distinct("study_id").alias("total"))
    joined = by.join(names, "latin_name").join(F.broadcast(total))  # one row
    return joined.select("latin_name", "common_names", "study_count", F.round(100 * F.col("study_count") / F.greatest("total", F.lit(1)), 4).alias("percent_of_species_annotated_studies"))


def corpus_tables(summaries: DataFrame, analyses: DataFrame, counts: DataFrame, untargeted: DataFrame, species: DataFrame) -> dict[str, DataFrame]:
    """The seven tables of a snapshot, from indexes with their duplicates."""
    studies, analysis = first_rows(summaries, ["study_id"]), first_rows(analyses, ["analysis_id"])
    index, pairs = first_rows(untargeted, ["analysis_id"]), first_rows(species.withColumn("study_id", F.coalesce("study_id", F.lit(""))).withColumn("latin_name", F.coalesce("latin_name", F.lit(""))), ["study_id", "latin_name"])
    known = classified(analysis, index)
    return {
        "study_summaries": studies, "study_species": pairs, "analyses": known, "analysis_metabolite_counts": first_rows(counts, ["analysis_id"]), "untargeted_analyses": index,
        "species_distribution": species_distribution(pairs), "study_assay_scope": study_scopes(studies, known),
    }


def corpus_metrics(tables: dict[str, DataFrame], raw: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of a snapshot: counts, duplicates removed, species and assay coverage, feature counts. ``raw`` has the
    indexes as they came, by the names of the tables that they became."""
    one = lambda df, **metrics: df.agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    found = []
    rows = lambda name, metric: found.append(one(tables[name], **{metric: F.count("*")}))
    gone = lambda name, metric: found.append(one(raw[name].select(F.lit(1).alias("x")).unionByName(tables[name].select(F.lit(-1).alias("x"))), **{metric: F.sum("x")}))
    for name, count, removed in (("study_summaries", "study_count", "study_summary_duplicate_rows_removed"), ("analyses", "analysis_count", "analysis_duplicate_rows_removed"), ("untargeted_analyses", "explicit_untargeted_index_analysis_count", "untargeted_duplicate_rows_removed"), ("analysis_metabolite_counts", "analysis_metabolite_count_rows", "analysis_metabolite_count_duplicate_rows_removed"), ("study_species", "species_unique_study_latin_name_pair_count", "species_duplicate_pair_rows_removed")):
        rows(name, count)
        gone(name, removed)
    species = tables["study_species"].select(F.trim("study_id").alias("study_id"), _or_unknown("latin_name").alias("latin_name")).distinct()
    per_study = species.groupBy("study_id").agg(F.count("*").alias("k"))
    found.append(one(per_study, species_annotated_study_count=F.count("*"), single_species_study_count=F.count_if(F.col("k") == 1), multi_species_study_count=F.count_if(F.col("k") > 1)))
    found.append(one(tables["species_distribution"], distinct_latin_name_count=F.count("*")))
    studies = tables["study_summaries"].filter(~_blank("study_id")).select("study_id").distinct()
    met = studies.withColumn("s", F.lit(1)).join(per_study.select("study_id", "k"), "study_id", "full_outer")
    found.append(one(met, species_missing_study_count=F.count_if(F.col("k").isNull()), species_index_only_study_count=F.count_if(F.col("s").isNull())))
    kinds = ("explicit_targeted", "explicit_untargeted", "unclassified_or_other")
    found.append(one(tables["analyses"], **{f"analysis_scope_counts.{k}": F.count_if(F.col("assay_scope") == k) for k in kinds}))
    categories = ("both_explicit", "targeted_explicit_only", "untargeted_explicit_only", "neither_explicit_or_no_analysis")
    found.append(one(tables["study_assay_scope"], **{f"study_assay_category_counts.{k}": F.count_if(F.col("study_assay_category") == k) for k in categories}))
    numbers = tables["analysis_metabolite_counts"].select(F.when(F.trim(F.col("num_metabolites")).rlike(r"^\d+$"), F.trim(F.col("num_metabolites")).cast("bigint")).alias("n"))
    found.append(one(numbers, analysis_metabolite_numeric_count_rows=F.count("n"), analysis_metabolite_blank_count_rows=F.count_if(F.col("n").isNull()), analysis_feature_row_sum=F.coalesce(F.sum("n"), F.lit(0)), analysis_feature_count_minimum=F.min("n"), analysis_feature_count_maximum=F.max("n")))
    found.append(quantiles(numbers, [], "n", [0.5], "q").agg(F.max(F.col("q")[0]).alias("analysis_feature_count_median")))
    lacking = tables["analyses"].select(F.lit(1).alias("x")).unionByName(tables["analysis_metabolite_counts"].select(F.lit(-1).alias("x")))
    found.append(one(lacking, analyses_without_metabolite_count_record=F.sum("x")))
    out = None
    for f in found:  # rows of one, so that a table of metrics costs no join
        part = f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in f.columns])).alias("m")).select("m.*")
        out = part if out is None else out.unionByName(part)
    return out

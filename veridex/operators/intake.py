"""Typed loads and intake: text rows become typed entities, or violations that stop the run before anything is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.collections import compact, factor_map, joined_set, parse_bool, parse_bool_strict, parse_float, parse_int, split_list
from ..functions.text import first_filled, is_mw_accession
from ..schemas import AVAILABILITY, MODALITY_FLAGS, REVIEW_STATUS
from ..sources.files import agreeing
from .constraints import ConstraintError, duplicates, enforce, outside
from .screening import publication_flags

# Other words for availability.
AVAILABILITY_ALIASES = {"open": "public", "available": "public", "restricted": "restricted_metadata_only", "controlled": "restricted_metadata_only", "closed": "not_available", "": "unknown"}


def availability(x: Column) -> Column:
    """An allowed availability, or NULL for a constraint to report."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    named = reduce(lambda c, kv: F.when(low == kv[0], F.lit(kv[1])).otherwise(c), AVAILABILITY_ALIASES.items(), low)
    return F.when(named.isin(*AVAILABILITY), named)


def publications(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Text rows as publications; ``strict`` takes only true and false, other flags are violations."""
    flags = ("human", *MODALITY_FLAGS)
    if strict:
        bad = reduce(lambda a, b: a | b, [parse_bool_strict(F.col(f)).isNull() for f in flags])
        enforce(rows.filter(bad).select("study_id"), "flags other than true and false")
    read = parse_bool_strict if strict else parse_bool
    default = lambda c, d: F.coalesce(first_filled(F.col(c)), F.lit(d)).alias(c) if c in rows.columns else F.lit(d).alias(c)
    out = rows.select("study_id", default("title", ""), default("doi", "not_reported"), default("pmid", "not_reported"), *[read(F.col(f)).alias(f) for f in flags], default("repository_accession", "not_available"), default("notes", ""))
    enforce(duplicates(out, "study_id"), "repeated study_id")
    return out


def repositories(rows: DataFrame) -> DataFrame:
    enforce(rows.filter(availability(F.col("public_status")).isNull()).select("study_id", "public_status"), "unknown availability")
    absent = split_list(F.col("documented_absent_modalities")) if "documented_absent_modalities" in rows.columns else F.array().cast("array<string>")
    text = lambda c: F.coalesce(first_filled(F.col(c)), F.lit("unknown")).alias(c)
    return rows.select("study_id", "repository", "accession", availability(F.col("public_status")).alias("public_status"), *[parse_bool(F.col(c)).alias(c) for c in ("has_metadata", "has_codebook", "has_data_files")], text("assay_platform"), text("sample_matrix"), text("biospecimen_timing"),
                       parse_int(F.col("sample_size")).alias("sample_size"), split_list(F.col("modalities")).alias("modalities"), absent.alias("documented_absent_modalities"))


def mappings(rows: DataFrame) -> DataFrame:
    """Expert or predicted mappings: aliased columns must agree, statuses are allowed ones, an unmapped row is rejected."""
    study, bad_study = agreeing(rows, "source_study", "study_id")
    common, bad_common = agreeing(rows, "common_variable", "proposed_common_variable")
    enforce(bad_study, "source_study and study_id differ")
    enforce(bad_common, "common_variable and proposed_common_variable differ")
    out = rows.select(study.alias("source_study"), "source_variable", common.alias("common_variable"), "review_status")
    enforce(outside(out, "review_status", REVIEW_STATUS), "unknown review status")
    enforce(out.filter("common_variable = 'not_mapped' and review_status <> 'rejected'"), "an unmapped row that isn't rejected")
    enforce(duplicates(out, "source_study", "source_variable"), "repeated entity")
    return out


def quality_scores(rows: DataFrame) -> DataFrame:
    """Scores as exact decimals; a missing score needs an out-of-scope status."""
    out = rows.select("study_id", F.col("overall_score").try_cast("decimal(10,6)").alias("overall_score"), first_filled(F.col("scope_status")).alias("scope_status"))
    enforce(out.filter("overall_score is null and coalesce(scope_status, '') <> 'out_of_scope_non_human'"), "a score is missing")
    enforce(duplicates(out, "study_id"), "repeated study_id")
    return out


def model_rows(rows: DataFrame, features: list[str], label: str, labels: tuple[str, str], complete: bool) -> DataFrame:
    """Declared features as doubles, others dropped. Training rows are complete and have two rows of each label."""
    out = rows.select("sample_id", "cohort_id", label, *[parse_float(F.col(f)).alias(f) for f in features])
    enforce(outside(out, label, labels), "unknown label")
    enforce(duplicates(out, "sample_id"), "repeated sample_id")
    if complete:
        enforce(out.filter(reduce(lambda a, b: a | b, [F.col(f).isNull() for f in features])).select("sample_id"), "a training row lacks a feature")
        counts = {r[label]: r.n for r in out.groupBy(label).agg(F.count("*").alias("n")).collect()}
        if any(counts.get(v, 0) < 2 for v in labels):
            raise ConstraintError(f"fewer than two rows of a label: {counts}")
    return out


def both_or_none(**inputs) -> str:
    """Optional inputs come together: "present" or "absent"."""
    given = [k for k, v in inputs.items() if v is not None]
    if given and len(given) != len(inputs):
        raise ConstraintError(f"only {given} of {sorted(inputs)} are given")
    return "present" if given else "absent"


def study_records(summaries: DataFrame, analyses: DataFrame, factors: DataFrame) -> DataFrame:
    """One record per study from its summary, analyses and sample factors; lists are sorted and distinct."""
    a = analyses.groupBy("study_id").agg(joined_set(F.col("analysis_summary")).alias("assay_platform"), F.count_distinct("analysis_id").alias("analyses"))
    f = factors.groupBy("study_id").agg(joined_set(F.col("sample_source")).alias("sample_matrix"), F.count_distinct("sample_id").alias("sample_size"), joined_set(F.concat_ws(",", F.array_sort(F.map_keys(factor_map(F.col("factors")))))).alias("factor_names"))
    out = summaries.join(a, "study_id", "left").join(f, "study_id", "left")
    text = F.concat_ws(" ", "title", "summary", "factor_names")
    return out.select("study_id", "title", F.coalesce("assay_platform", F.lit("unknown")).alias("assay_platform"), F.coalesce("sample_matrix", F.lit("unknown")).alias("sample_matrix"), "sample_size", "analyses", *[c.alias(n) for n, c in publication_flags(text).items()])


def assay_scope(indexed: Column, label: Column) -> Column:
    """targeted / untargeted by index membership, else by the label's words, else other."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.when(indexed.isNotNull(), indexed).when(low.rlike("(^|[^a-z])untargeted"), "untargeted").when(low.rlike("(^|[^a-z])targeted"), "targeted").otherwise("other")


def study_category(scopes: DataFrame, key: str, scope: str) -> DataFrame:
    has = lambda v: F.bool_or(F.col(scope) == v)
    return scopes.groupBy(key).agg(F.when(has("targeted") & has("untargeted"), "both").when(has("targeted"), "targeted").when(has("untargeted"), "untargeted").otherwise("other").alias("category"))


# Names of scopes and hierarchy levels.
SCOPES = {"all": "all_tissues", "all_tissues": "all_tissues", "blood": "blood_plasma", "plasma": "blood_plasma", "blood_plasma": "blood_plasma"}
LEVELS = {"super": "super_class", "super_class": "super_class", "main": "main_class", "main_class": "main_class", "sub": "sub_class", "sub_class": "sub_class", "pathway": "pathway"}


def resolve(value: str, table: dict[str, str], what: str) -> str:
    """An alias's meaning; unknown ones raise."""
    key = value.strip().lower().replace("-", "_").replace(" ", "_")
    if key not in table:
        raise ConstraintError(f"unknown {what} {value!r}")
    return table[key]


def resolved(value: Column, table: dict[str, str]) -> Column:
    """The same for a column; unknown aliases are NULL for a constraint to report."""
    key = F.regexp_replace(F.lower(F.trim(value)), "[- ]", "_")
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def in_scope(df: DataFrame, scope: str, tissue: str = "tissue", contrasts: list[str] | None = None, targeted: str | None = None) -> DataFrame:
    """Rows of a tissue scope, of listed contrasts, and targeted, untargeted or all."""
    out = df.filter(F.lower(tissue).rlike("blood|plasma")) if resolve(scope, SCOPES, "scope") == "blood_plasma" else df
    if contrasts is not None:
        out = out.filter(F.col("contrast").isin(*contrasts))
    if targeted is not None:
        out = out.filter(F.lower("assay").startswith(resolve(targeted, {"targeted": "targeted", "untargeted": "untargeted"}, "assay kind")))
    return out


def without_standards(df: DataFrame, name: str) -> DataFrame:
    """Rows that are no internal standards: labelled compounds and names that say so."""
    return df.filter(~F.coalesce(F.lower(name).rlike(r"(^|[^a-z])(istd|is_|internal standard)|[-_ (]d\d+\b|13c|15n"), F.lit(False)))


def effect_profile(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows that name a feature in one of the columns, as a coverage profile over the whole table: one scan."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.trim(F.col(c))) == name.lower(), F.lit(False)) for c in columns])
    return df.agg(F.count("*").alias("rows"), F.count_if(hit).alias("hits"), F.count_distinct(F.col(columns[0])).alias("features"), F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("tissue")))), ";").alias("tissues"))


def sample_map(samples: DataFrame) -> DataFrame:
    """Samples with pre or post by their collection point, participant by the id before its last "_", sex where reported."""
    point = F.lower(F.trim("collection_point"))
    when = F.when(point.startswith("before"), "pre").when(point.startswith("after"), "post").otherwise("unknown")
    return samples.select("sample_id", F.regexp_replace("sample_id", "_[^_]*$", "").alias("participant"), when.alias("timepoint"), F.coalesce(first_filled(F.col("sex")), F.lit("not_reported")).alias("sex"))


def complementary_key(accession: Column) -> Column:
    """Which registry an accession leads to."""
    return F.when(is_mw_accession(accession), "metabolomics_workbench").when(accession.isNull() | (F.trim(accession) == ""), "none").otherwise("other")


def synthetic_cohort(spark: SparkSession, samples: int, features: int, cohorts: int = 2) -> DataFrame:
    """Deterministic test data: modular waves over sample and feature numbers, a shift in the first feature by label."""
    wave = lambda a, b, m: ((F.col("i") * a + F.col("f") * b) % m) / F.lit(float(m)) - 0.5
    grid = spark.range(samples).withColumnRenamed("id", "i").select("i", F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("f"))
    value = wave(7, 13, 31) + F.when((F.col("f") == 0) & (F.col("i") % 2 == 1), 1.0).otherwise(0.0)
    return grid.select(F.concat(F.lit("s"), "i").alias("sample_id"), F.concat(F.lit("c"), F.col("i") % cohorts).alias("cohort_id"), (F.col("i") % 2).alias("label"), F.col("f").alias("feature"), F.round(value, 6).alias("value"))


def stated(columns: dict[str, Column]) -> Column:
    """Names of the columns that are filled, for reports of what is documented."""
    return compact(*[F.when(first_filled(c).isNotNull(), F.lit(n)) for n, c in columns.items()])

"""Catalog rules: usable assets, recommendation, readiness and alignment scores, modality evidence.

Decision tables are sums of ``when`` columns over one scan. NULL means not documented; where a rule treats that as
"not met" it says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collections import compact, when_flag
from ..functions.text import is_blood_matrix, is_mw_accession, norm_name
from ..schemas import MIRAGE_UNKNOWN, QUALITY_UNREPORTED


def _true(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _known(c: str, unknown) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin(*unknown)


def points(*rules: tuple[Column, float], base: float = 0.0) -> Column:
    return reduce(lambda a, r: a + F.when(r[0], F.lit(r[1])).otherwise(F.lit(0.0)), rules, F.lit(base))


#: Flags that make a study unusable.
SEVERE = ("no_repository_accession", "no_downloadable_metadata", "no_variable_dictionary_or_codebook", "restricted_data_without_metadata", "repository_data_not_available")


def mirage_flags(has_repository: Column) -> Column:
    """What a study lacks, in a fixed order. Without a repository record only two flags can apply.

    Reads accession, repository_accession, metabolomics, public_status, has_metadata, has_codebook, has_data_files,
    assay_platform, biospecimen_timing and sample_size.
    """
    number = F.when(has_repository, F.col("accession")).otherwise(F.col("repository_accession"))
    missing = number.isNull() | number.isin(*MIRAGE_UNKNOWN)
    inside = lambda c, name: when_flag(has_repository & c, name)
    return compact(
        when_flag(missing, "no_repository_accession"),
        when_flag(~has_repository & _true("metabolomics"), "no_repository_record"),
        inside((F.col("public_status") == "restricted_metadata_only") & ~_true("has_metadata"), "restricted_data_without_metadata"),
        inside(F.col("public_status") == "not_available", "repository_data_not_available"),
        inside(~_true("has_metadata"), "no_downloadable_metadata"),
        inside(~_true("has_codebook"), "no_variable_dictionary_or_codebook"),
        inside(~_true("has_data_files"), "no_data_files"),
        inside(~_known("assay_platform", MIRAGE_UNKNOWN), "unclear_assay_platform"),
        inside(~_known("biospecimen_timing", MIRAGE_UNKNOWN), "unclear_biospecimen_timing"),
        inside(F.col("sample_size").isNull(), "sample_size_not_reported"),
    )


def is_mirage(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(s) for s in SEVERE]))


#: Terms asked for when a query names none.
PREFERRED = ("exercise", "actigraphy", "genetics", "cpet", "body_composition", "diet")
SUPPORTED_TERMS = ("human", "metabolomics", *PREFERRED, "physical_activity")


def criteria(query: str) -> list[str]:
    """Preferred terms that a query text mentions; all of them if none."""
    text = query.lower().replace("-", " ").replace("_", " ")
    found = [t for t in PREFERRED if t.replace("_", " ") in text]
    if "activity" in text and "physical_activity" not in found:
        found.append("physical_activity")
    if "vo2" in text and "cpet" not in found:
        found.append("cpet")
    return found or list(PREFERRED)


def recommend(studies: DataFrame, preferred=PREFERRED, required=("human", "metabolomics")) -> DataFrame:
    """score, recommendation_class and mirage_flags of studies that were left-joined with their repository record
    (``repository`` is NULL where there is none)."""
    unknown = [t for t in (*preferred, *required) if t not in SUPPORTED_TERMS]
    if unknown:
        raise ValueError(f"unsupported terms: {unknown}")
    has = F.col("repository").isNotNull()
    term = lambda t: _true("exercise") | _true("actigraphy") if t == "physical_activity" else _true(t)
    unmet = reduce(lambda a, b: a | b, [~term(t) for t in required], F.lit(False))
    workbench = has & (F.lower(F.col("repository")).contains("metabolomics workbench") | is_mw_accession(F.col("accession")))
    excluded = unmet | (~has & is_mw_accession(F.col("repository_accession"))) | (workbench & ~is_blood_matrix(F.col("sample_matrix")))
    on = lambda t: F.lit(t in preferred) & term(t)
    reported = F.col("repository_accession").isNotNull() & ~F.col("repository_accession").isin("", "not_available", "not_reported")
    score = points(
        (on("exercise"), 0.12), (on("actigraphy"), 0.12), (on("physical_activity"), 0.08), (on("exercise") & on("actigraphy"), 0.04), (on("genetics"), 0.10), (on("cpet"), 0.08),
        (on("body_composition"), 0.05), (on("diet"), 0.05), (reported, 0.05), (has & _true("has_metadata"), 0.03), (has & _true("has_codebook"), 0.03), (has & _true("has_data_files"), 0.02),
        (has & F.col("sample_size").isNotNull(), 0.02), (has & _known("assay_platform", MIRAGE_UNKNOWN), 0.01), (has & _known("biospecimen_timing", MIRAGE_UNKNOWN), 0.01), base=0.40,
    )
    out = studies.withColumn("mirage_flags", mirage_flags(has))
    kind = (
        F.when(excluded, "excluded").when(is_mirage(F.col("mirage_flags")), "mirage")
        .when(_true("exercise") | _true("actigraphy") | _true("cpet"), "direct_match")
        .when(_true("genetics") | _true("body_composition") | _true("diet"), "enrichment_candidate").otherwise("complementary")
    )
    return out.withColumn("score", F.when(excluded, F.lit(0.0)).otherwise(F.least(F.round(score, 3), F.lit(1.0)))).withColumn("recommendation_class", kind)


#: Weights of the ten subscores.
QUALITY_WEIGHTS = {
    "study_design_rigor": 0.15, "metadata_completeness": 0.15, "metabolomics_quality": 0.15, "activity_quality": 0.10, "genetics_quality": 0.10,
    "cpet_quality": 0.10, "body_composition_quality": 0.05, "diet_quality": 0.05, "temporal_alignment": 0.10, "harmonization_feasibility": 0.05,
}


def scope_status(human: Column) -> Column:
    return F.when(human.isNull(), "human_status_unknown").when(human, "in_scope_human").otherwise("out_of_scope_non_human")


def quality(datasets: DataFrame, weights=QUALITY_WEIGHTS) -> DataFrame:
    """Ten subscores and their weighted sum; the sum is NULL for studies that are documented as non-human.

    Reads modalities (of dataset and study together), human, sample_size, the asset flags and the three descriptors.
    """
    has = lambda *names: F.arrays_overlap(F.coalesce(F.col("modalities"), F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]))
    known = {c: _known(c, QUALITY_UNREPORTED) for c in ("assay_platform", "sample_matrix", "biospecimen_timing")}
    sampled = F.coalesce(F.col("sample_size") > 0, F.lit(False))
    active = has("exercise", "actigraphy", "physical_activity")
    items = [_true("has_metadata"), _true("has_codebook"), _true("has_data_files"), *known.values(), sampled]
    sub = {
        "study_design_rigor": F.least(F.lit(1.0), points((_true("human"), 0.2), (sampled & (F.col("sample_size") >= 100), 0.2), (sampled & (F.col("sample_size") < 100), 0.1), (active & has("metabolomics"), 0.2), base=0.4)),
        "metadata_completeness": points(*[(i, 1.0) for i in items]) / len(items),
        "metabolomics_quality": F.when(has("metabolomics"), points((known["assay_platform"], 0.25), (known["sample_matrix"], 0.15), (_true("has_data_files"), 0.20), base=0.4)).otherwise(F.lit(0.0)),
        "activity_quality": F.when(has("actigraphy", "physical_activity"), 0.85).when(has("exercise"), 0.70).otherwise(0.25),
        "genetics_quality": F.when(has("genetics"), 0.8).otherwise(0.35),
        "cpet_quality": F.when(has("cpet"), 0.85).otherwise(0.25),
        "body_composition_quality": F.when(has("body_composition"), 0.80).otherwise(0.30),
        "diet_quality": F.when(has("diet"), 0.75).otherwise(0.30),
        "temporal_alignment": F.when(known["biospecimen_timing"] & active, 0.80).otherwise(0.35),
        "harmonization_feasibility": F.when(_true("has_codebook") & _true("has_metadata"), 0.85).otherwise(0.25),
    }
    out = datasets.withColumns({k: F.round(v, 3) for k, v in sub.items()}).withColumn("scope_status", scope_status(F.col("human")))
    total = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in weights.items()])
    # ten digits first: a sum a few ulps below a .0005 border must not round down
    return out.withColumn("overall_score", F.when(F.col("scope_status") != "out_of_scope_non_human", F.round(F.round(total, 10), 3)))


def alignment(datasets: DataFrame) -> DataFrame:
    """Eleven checks, their share and a tier; human evidence is a hard gate."""
    mods = F.coalesce(F.col("modalities"), F.array().cast("array<string>"))
    absent = F.coalesce(F.col("documented_absent_modalities"), F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(mods, F.array(*[F.lit(n) for n in names]))
    human = _true("human")
    checks = {
        "human": human, "metabolomics": has("metabolomics"), "activity": has("exercise", "actigraphy", "physical_activity"), "timing": _known("biospecimen_timing", QUALITY_UNREPORTED),
        "matrix": _known("sample_matrix", QUALITY_UNREPORTED), "platform": _known("assay_platform", QUALITY_UNREPORTED), "genetics": has("genetics") | F.array_contains(absent, "genetics"),
        "cpet": has("cpet"), "body_composition": has("body_composition"), "diet": has("diet"), "codebook": _true("has_codebook"),
    }
    met = points(*[(c, 1.0) for c in checks.values()])
    score = F.round(met / len(checks), 3)
    tier = F.when(~human, "not_feasible").when(score >= 0.85, "high").when(score >= 0.65, "moderate").when(score >= 0.40, "low").otherwise("not_feasible")
    missing = compact(*[when_flag(~c, n) for n, c in checks.items()])
    return datasets.withColumn("alignment_score", score).withColumn("alignment_tier", tier).withColumn("missing_elements", missing)


# Synonyms of common variables, in priority order, with unit and expected modalities.
COMMON_VARIABLES = {
    "vo2max": (("vo2max", "vo2_max", "vo2peak", "peak_vo2", "cardiorespiratory_fitness"), "mL/kg/min", ("cpet", "exercise")),
    "steps_per_day": (("steps", "daily_steps", "mean_steps", "steps_per_day"), "steps/day", ("actigraphy", "physical_activity")),
    "mvpa_minutes": (("mvpa", "mvpa_min", "moderate_vigorous_physical_activity", "moderate_vigorous_minutes", "moderate_to_vigorous_activity"), "min/day", ("actigraphy", "physical_activity")),
    "age": (("age", "participant_age"), "years", ("demographics", "clinical")),
    "sex": (("sex", "biological_sex", "gender"), "category", ("demographics", "clinical")),
    "bmi": (("bmi", "body_mass_index"), "kg/m^2", ("body_composition", "clinical")),
    "fasting_glucose": (("fasting_glucose", "glucose_fasting"), "mg/dL", ("metabolomics", "clinical")),
    "insulin": (("insulin", "fasting_insulin"), "uIU/mL", ("metabolomics", "clinical")),
    "lean_mass": (("lean_mass", "total_lean_mass", "dxa_lean_mass"), "kg", ("body_composition",)),
    "fat_mass": (("fat_mass", "total_fat_mass", "dxa_fat_mass"), "kg", ("body_composition",)),
}
UNIT_CONVERSIONS = {("fasting_glucose", "mmol/l", "mg/dl"): "multiply_by_18.0182"}
APPROVED_TRANSFORMS = ("identity", "multiply_by_18.0182")
NOT_ALIKE = {"vo2max": ("vo2peak", "peak_vo2"), "sex": ("gender",)}


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` bound to a name: however often it is used, and filtered by, it is one expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def crosswalk(cards: DataFrame, variables=COMMON_VARIABLES) -> DataFrame:
    """Variable cards with a proposed common variable, transform, confidence and review status.

    The synonym table is small and fixed, so it is a chain of conditions inside the scan: no join at all.
    """
    pick = lambda tests: F.coalesce(*[F.when(c, F.lit(v)) for v, c in tests.items()])
    wrap = lambda c: F.concat(F.lit("_"), c, F.lit("_"))
    near = lambda c, s: F.contains(wrap(c), F.lit(f"_{s}_")) | ((c != "") & F.contains(F.lit(f"_{s}_"), wrap(c)))
    either = lambda tests: reduce(lambda a, b: a | b, tests)
    of = lambda v, value: reduce(lambda c, kv: F.when(v == kv[0], value(kv[1])).otherwise(c), variables.items(), F.lit(None))
    unit = F.lower(F.trim(F.coalesce("unit", F.lit("unknown"))))
    timing_ok = ~F.lower(F.coalesce("timing", F.lit("unknown"))).isin("", "unknown", "not_reported")

    def named(x: Column) -> Column:
        """The variable by exact synonyms, else by near ones."""
        exact = {v: x["n"].isin(*s) | x["l"].isin(*s) for v, (s, _, _) in variables.items()}
        partial = {v: either([near(x["n"], y) | near(x["l"], y) for y in s]) for v, (s, _, _) in variables.items()}
        return _let(F.struct(x["n"].alias("n"), x["l"].alias("l"), pick(exact).alias("exact"), pick(partial).alias("partial")), found)

    def found(x: Column) -> Column:
        v = F.coalesce(x["exact"], x["partial"], F.lit("not_mapped"))
        kind = F.when(x["exact"].isNotNull(), "name_or_label_synonym").when(x["partial"].isNotNull(), "partial_name_similarity").otherwise("no_supported_synonym")
        return _let(F.struct(x["n"].alias("n"), x["l"].alias("l"), v.alias("v"), kind.alias("kind")), converted)

    def converted(x: Column) -> Column:
        v, target = x["v"], F.lower(of(x["v"], lambda y: F.lit(y[1])))
        conversion = reduce(lambda c, kv: F.when((v == kv[0][0]) & (unit == kv[0][1]) & (target == kv[0][2]), F.lit(kv[1])).otherwise(c), UNIT_CONVERSIONS.items(), F.lit(None).cast("string"))
        transform = F.when((v == "not_mapped") | unit.isin("", "unknown", "not_reported"), "not_available").when(unit == target, "identity").otherwise(F.coalesce(conversion, F.lit("unit_conversion_requires_review")))
        modality_ok = F.coalesce(of(v, lambda y: F.col("modality").isin(*y[2])).cast("boolean"), F.lit(False))
        caveat = ((v == "vo2max") & x["n"].isin(*NOT_ALIKE["vo2max"])) | ((v == "sex") & (x["n"].isin(*NOT_ALIKE["sex"]) | x["l"].isin(*NOT_ALIKE["sex"])))
        own = {"n": x["n"], "v": v, "kind": x["kind"], "unit": F.coalesce(of(v, lambda y: F.lit(y[1])), F.lit("not_available")), "transform": transform, "modality_ok": modality_ok, "caveat": F.coalesce(caveat, F.lit(False))}
        return _let(F.struct(*[c.alias(n) for n, c in own.items()]), weighed)

    def weighed(x: Column) -> Column:
        unit_ok = x["transform"].isin(*APPROVED_TRANSFORMS)
        points = 0.50 + F.when(x["n"] == x["v"], 0.20).otherwise(0.12) + F.when(unit_ok, 0.12).otherwise(-0.12) + F.when(x["modality_ok"], 0.10).otherwise(-0.22) + F.when(timing_ok, 0.04).otherwise(-0.08)
        sure = F.greatest(F.lit(0.0), F.least(F.round(F.when(x["caveat"], F.least(points, F.lit(0.78))).otherwise(points), 2), F.lit(0.99)))
        own = {**{c: x[c] for c in ("n", "v", "kind", "unit", "transform", "modality_ok", "caveat")}, "unit_ok": unit_ok, "confidence": F.when(x["v"] == "not_mapped", 0.20).otherwise(sure)}
        return _let(F.struct(*[c.alias(n) for n, c in own.items()]), judged)

    def judged(x: Column) -> Column:
        v, confidence = x["v"], x["confidence"]
        accepted = (confidence >= 0.90) & x["unit_ok"] & timing_ok & ((v != "vo2max") | (x["n"] == "vo2max"))
        status = F.when((v == "not_mapped") | ~x["modality_ok"], "rejected").when(accepted, "accepted").when(confidence >= 0.40, "requires_human_review").otherwise("rejected")
        own = {"common_variable": v, "evidence_kind": x["kind"], "common_unit": x["unit"], "transform": x["transform"], "confidence": confidence, "review_status": status, "construct_caveat": x["caveat"]}
        return F.struct(*[c.alias(n) for n, c in own.items()])

    names = F.struct(norm_name(F.coalesce(F.col("source_variable"), F.lit(""))).alias("n"), norm_name(F.coalesce(F.col("label"), F.lit(""))).alias("l"))
    return cards.withColumn("_mapped", _let(names, named)).select(*cards.columns, "_mapped.*")


def review_reason(mapped: DataFrame) -> DataFrame:
    """Why a mapping needs a person; the first reason that applies."""
    reason = (
        F.when(F.col("review_status") == "accepted", "none")
        .when((F.col("common_variable") == "vo2max") & F.col("construct_caveat"), "confirm_exercise_protocol")
        .when((F.col("common_variable") == "sex") & F.col("construct_caveat"), "confirm_sex_or_gender")
        .when(F.col("transform") == "unit_conversion_requires_review", "confirm_unit_conversion")
        .when(F.col("review_status") == "rejected", "rejected_by_guardrail").otherwise("insufficient_confidence_or_metadata")
    )
    return mapped.withColumn("review_reason", reason)


def approved() -> Column:
    """Whether a mapping is accepted and has an approved transform."""
    return F.coalesce((F.col("review_status") == "accepted") & F.col("transform").isin(*APPROVED_TRANSFORMS), F.lit(False))


def transform_plan(mapped: DataFrame) -> DataFrame:
    """Only mappings that may be transformed."""
    return mapped.filter(approved())

"""Pairwise assay harmonisation: identity, quantification and QA/QC of two records, and what may be done with them.

A record is one flat row; see FIELDS. Candidates come from shared identifiers by equi-join; a pair is oriented by
feature_id, so decisions don't depend on input order. Names are never evidence of identity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_identifier, norm_scheme, norm_unit
from ..schemas import ASSAY_MISSING
from ..staging import release, stage
from .blocking import shared_pairs
from .constraints import enforce

FIELDS = (
    "feature_id string, ids array<struct<scheme:string,value:string,resolution:string>>, resolution string, msi_level_1 boolean, authentic_standard boolean, provenance_resolved boolean, "
    "quantitation_type string, scale string, unit string, sample_matrix string, calibration_model string, calibration_traceability string, internal_standard string, reference_material string, "
    "platform_family string, method_id string, assay_version string, bridges array<string>, missing_fraction double, missing_codes boolean, missing_reason string, zero_distinguished boolean, imputation string, "
    "unimputed_available boolean, censoring_policy string, censoring_flags boolean, below_limit_code string, loq double, loq_unit string, qc_cv double, run_order string, run_randomized boolean, pooled_qc boolean, "
    "pooled_qc_frequency string, drift_evaluated boolean, drift_method string, correction_scope string, batch_count int, batch_id string, blanks_documented boolean"
)
# Policy limits.
POLICY = {"missing": 0.20, "hard_missing": 0.50, "cv_targeted": 20.0, "cv_other": 30.0}
# Each unit with its dimension, the factor to the dimension's base, and the common unit.
UNITS = {
    "mol/l": ("molar_concentration", 1.0, "umol/L"),
    "mmol/l": ("molar_concentration", 1e-3, "umol/L"),
    "umol/l": ("molar_concentration", 1e-6, "umol/L"),
    "nmol/l": ("molar_concentration", 1e-9, "umol/L"),
    "pmol/l": ("molar_concentration", 1e-12, "umol/L"),
    "g/l": ("mass_concentration", 1.0, "mg/L"),
    "mg/l": ("mass_concentration", 1e-3, "mg/L"),
    "ug/l": ("mass_concentration", 1e-6, "mg/L"),
    "ng/l": ("mass_concentration", 1e-9, "mg/L"),
    "mg/dl": ("mass_concentration", 1e-2, "mg/L"),
    "ug/ml": ("mass_concentration", 1e-3, "mg/L"),
    "ng/ml": ("mass_concentration", 1e-6, "mg/L"),
}
#: Of each dimension its common unit and that one's factor.
COMMON = {dimension: (unit, UNITS[unit.lower()][1]) for dimension, _, unit in UNITS.values()}
# Ranks of resolutions and of identifier schemes.
RESOLUTION = ("feature_only", "chemical_class", "lipid_species", "positional_isomer_unresolved", "stereochemistry_unresolved", "exact_structure")
SCHEMES = ("refmet", "kegg", "lipidmaps", "pubchem_cid", "hmdb", "chebi", "inchikey")
NEEDS_STANDARD = ("lc_ms_targeted", "lc_ms_untargeted", "gc_ms", "direct_infusion_ms", "commercial_kit")
DISQUALIFY = ("irreversible", "cross_study_batch_correction", "qc_cv_exceeds_threshold", "missingness_exceeds_hard_limit")


def _missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*ASSAY_MISSING)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _lookup(c: Column, table: dict, value) -> Column:
    """The value of c's entry; a map, as a chain of conditions would build c again for each key."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, value(v))]), c)


#: What a pair needs of a record; its own blockers are found before pairing.
PAIRED = (
    "feature_id", "ids", "resolution", "msi_level_1", "authentic_standard", "quantitation_type", "scale", "dimension", "sample_matrix", "calibration_model", "calibration_traceability", "internal_standard", "reference_material",
    "platform_family", "method_id", "assay_version", "bridges", "loq", "loq_base", "provenance", "integrity", "limits", "hard", "qaqc", "qaqc_hard",
)


def normalised(records: DataFrame) -> DataFrame:
    """Identifiers in one spelling, the unit's dimension and factor, and the blockers that a record has by itself."""
    unit = norm_unit(F.col("unit"))
    ids = F.transform("ids", lambda x: F.struct(norm_scheme(x["scheme"]).alias("scheme"), norm_identifier(x["scheme"], x["value"]).alias("value"), x["resolution"].alias("resolution")))
    loq = norm_unit(F.col("loq_unit"))
    known = records.withColumns({
        "ids": ids, "dimension": _lookup(unit, UNITS, lambda v: v[0]).cast("string"), "factor": _lookup(unit, UNITS, lambda v: v[1]).cast("double"),
        "loq_dimension": _lookup(loq, UNITS, lambda v: v[0]).cast("string"), "loq_base": F.col("loq") * _lookup(loq, UNITS, lambda v: v[1]).cast("double"),
    })
    own = lambda rules: F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    return known.withColumns({
        "provenance": own([(~_yes(F.col("provenance_resolved")), "unresolved_identity_provenance")]), "integrity": own(_integrity(F.col)), "limits": own(_limits(F.col)),
        "hard": _yes((F.col("missing_fraction") > POLICY["hard_missing"]) | _imputed(F.col) | _imputing(F.col) | _wrong_unit(F.col)),
        "qaqc": own(_qaqc_rules(F.col)), "qaqc_hard": reduce(lambda a, b: a | b, [_yes(cond) for cond, _ in _hard_rules(F.col)]),
    }).select(*PAIRED)


def candidates(records: DataFrame) -> DataFrame:
    """Pairs of feature ids that share an identifier, each once; a hot identifier is cut into tiles (blocking.py)."""
    ids = records.select("feature_id", F.explode("ids").alias("x")).select("feature_id", F.concat(norm_scheme(F.col("x.scheme")), F.lit("\t"), norm_identifier(F.col("x.scheme"), F.col("x.value"))).alias("identifier"))
    return shared_pairs(ids, "feature_id", "identifier").select(F.col("left_key").alias("left_id"), F.col("right_key").alias("right_id"))


def paired(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(l, r) structs of oriented pairs."""
    low, high = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    checked = pairs.select(low.alias("left_id"), high.alias("right_id")).distinct()
    whole = F.struct(*[F.col(c) for c in records.columns])
    return checked.join(records.select(F.col("feature_id").alias("left_id"), whole.alias("l")), "left_id").join(records.select(F.col("feature_id").alias("right_id"), whole.alias("r")), "right_id")


def _evidence(left: str, right: str) -> Column:
    """What two lists of identifiers say of identity: a clash of keys, no shared one, a conflict, an exact one, the best one."""
    of = lambda side, scheme: F.array_distinct(F.transform(F.filter(F.col(side), lambda x: x["scheme"] == scheme), lambda x: x["value"]))
    lk, rk = of(left, "inchikey"), of(right, "inchikey")
    clash = (F.size(lk) > 0) & (F.size(rk) > 0) & ~F.arrays_overlap(lk, rk)
    blocks = lambda keys: F.transform(keys, lambda k: F.substring_index(k, "-", 1))
    shared = F.flatten(F.transform(left, lambda x: F.transform(F.filter(right, lambda y: (y["scheme"] == x["scheme"]) & (y["value"] == x["value"])), lambda y: F.struct(
        F.least(F.array_position(F.array(*[F.lit(v) for v in RESOLUTION]), x["resolution"]), F.array_position(F.array(*[F.lit(v) for v in RESOLUTION]), y["resolution"])).alias("rank"),
        F.array_position(F.array(*[F.lit(v) for v in SCHEMES]), x["scheme"]).alias("scheme_rank"), F.concat_ws(":", x["scheme"], x["value"]).alias("identity"),
        ((x["resolution"] == "exact_structure") & (y["resolution"] == "exact_structure")).alias("exact")))))
    best = F.array_max(shared)
    conflict = reduce(lambda a, b: a | b, [(F.size(of(left, s)) > 0) & (F.size(of(right, s)) > 0) & ~F.arrays_overlap(of(left, s), of(right, s)) for s in SCHEMES])
    return F.struct(
        F.when(clash, F.when(F.arrays_overlap(blocks(lk), blocks(rk)), F.lit("inchikey_layer_conflict")).otherwise(F.lit("inchikey_structure_conflict"))).alias("clash"),
        (F.size(shared) == 0).alias("none"), conflict.alias("conflict"), _yes(best["exact"]).alias("exact"), F.coalesce(best["identity"], F.lit("not_established")).alias("identity"))


#: The part of the evidence that a decision depends on.
KIND = ("clash", "none", "conflict", "exact")


def _identity() -> dict[str, Column]:
    clash, none = F.col("clash").isNotNull(), F.col("none")
    exact = F.col("exact") & _yes((F.col("l.resolution") == "exact_structure") & (F.col("r.resolution") == "exact_structure"))
    proven = _yes(F.col("l.msi_level_1") & F.col("r.msi_level_1") & F.col("l.authentic_standard") & F.col("r.authentic_standard"))
    blockers = [
        F.col("clash"), F.when(~clash & none, F.lit("identity_not_machine_resolved")), F.when(~clash & ~none & F.col("conflict"), F.lit("cross_identifier_conflict")),
        F.when(~clash & ~none & ~exact, F.lit("isomer_or_stereochemistry_unresolved")), F.when(~clash & ~none & ~proven, F.lit("msi_level_1_evidence_required")),
    ]
    found = F.array_compact(F.array(*blockers))
    some = F.size(F.concat("l.provenance", "r.provenance", found)) > 0
    status = F.when(clash, "non_combinable").when(none | some, "requires_human_review").otherwise("accepted")
    confidence = F.when(clash, 0.05).when(none, 0.20).when(~some, 0.98).when(exact, 0.72).otherwise(0.55)
    return {"identity_status": status, "identity_confidence": confidence, "identity_blockers": found, "identity_left": F.col("l.provenance"), "identity_right": F.col("r.provenance")}


def _imputed(g) -> Column:
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce(g("imputation"), F.lit("")))), " ", "_")
    return ~kind.isin(*ASSAY_MISSING, "not_applied", "no_imputation") & ~_yes(g("unimputed_available"))


def _integrity(g) -> list[tuple[Column, str]]:
    m = g("missing_fraction")
    return [
        (m > POLICY["hard_missing"], "missingness_exceeds_hard_limit"), ((m > POLICY["missing"]) & (m <= POLICY["hard_missing"]), "missingness_requires_sensitivity_analysis"), ((m > 0) & ~_yes(g("missing_codes")), "missing_value_codes_not_documented"),
        ((m > 0) & _missing(g("missing_reason")), "missing_reason_not_preserved"), (~_yes(g("zero_distinguished")), "biological_zero_not_distinguished"), (_imputed(g), "irreversible_imputation"),
    ]


def _imputing(g) -> Column:
    return g("censoring_policy").isin("half_limit_imputed", "zero_imputed", "minimum_value_imputed") & ~_yes(g("unimputed_available"))


def _wrong_unit(g) -> Column:
    """A limit in another dimension than its record's; it only counts where both records have one dimension."""
    return g("loq").isNotNull() & (g("loq_dimension").isNull() | (g("loq_dimension") != g("dimension")))


def _limits(g) -> list[tuple[Column, str]]:
    return _integrity(g) + [
        (_imputing(g), "irreversible_below_limit_imputation"), (g("censoring_policy") == "none_expected", "absolute_concentration_censoring_not_defined"), (g("censoring_policy") == "unknown", "below_limit_policy_unknown"),
        (~_yes(g("censoring_flags")), "below_limit_flags_unavailable"), (_missing(g("below_limit_code")), "below_limit_code_missing"), (g("loq").isNull(), "loq_not_reported"), (_wrong_unit(g), "loq_unit_incompatible"),
        (_missing(g("calibration_model")) | _missing(g("calibration_traceability")), "calibration_traceability_missing"),
    ]


def _quantity() -> dict[str, Column]:
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    absolute = (l("quantitation_type") == "absolute_concentration") & (r("quantitation_type") == "absolute_concentration")
    linear, known = (l("scale") == "linear") & (r("scale") == "linear"), l("dimension").isNotNull() & r("dimension").isNotNull()
    same_dimension, same_matrix = l("dimension") == r("dimension"), F.lower(F.trim(l("sample_matrix"))) == F.lower(F.trim(r("sample_matrix")))
    differ = lambda c: F.coalesce(F.trim(l(c)), F.lit("")) != F.coalesce(F.trim(r(c)), F.lit(""))
    same_method = ~(differ("method_id") | differ("assay_version") | differ("platform_family"))
    bridged = F.size(F.array_intersect(l("bridges"), r("bridges"))) > 0
    whole = [F.when(differ(c), F.lit(n)) for c, n in (("calibration_model", "calibration_models_differ"), ("calibration_traceability", "calibration_traceability_differs"), ("internal_standard", "internal_standards_differ"), ("reference_material", "reference_materials_differ"))]
    whole.append(F.when(~same_method & ~bridged, F.lit("unbridged_assay_methods")))
    full = F.array_compact(F.array(*whole))
    bare = F.array(F.when(l("quantitation_type") != r("quantitation_type"), F.lit("quantitation_type_incompatible")).otherwise(F.lit("non_absolute_values_not_poolable")))
    one = lambda name: F.array(F.lit(name))
    blockers = F.when(~absolute, bare).when(~linear, one("nonlinear_or_unknown_scale")).when(~known, one("unit_not_in_registry")).when(~same_dimension, one("concentration_dimension_mismatch")).when(~same_matrix, one("biospecimen_matrix_incompatible")).otherwise(full)
    own = lambda g: F.when(~absolute, g("integrity")).when(linear & known & same_dimension & same_matrix, g("limits")).otherwise(F.array().cast("array<string>"))
    some = F.size(F.concat(blockers, own(l), own(r))) > 0
    hard = l("hard") | r("hard")
    review = absolute & (~linear | ~known | ~same_dimension)
    status = F.when(~absolute | (absolute & ~review & ~same_matrix) | (absolute & ~review & hard), "non_combinable").when(review | some, "requires_human_review").otherwise("accepted")
    confidence = F.when(~absolute, 0.10).when(~linear, 0.45).when(~known, 0.40).when(~same_dimension, 0.35).when(~same_matrix, 0.10).when(hard, 0.15).when(some, 0.60).otherwise(0.94)
    base = F.greatest(l("loq_base"), r("loq_base"))
    return {"quantity_status": status, "quantity_confidence": confidence, "quantity_blockers": blockers, "quantity_left": own(l), "quantity_right": own(r), "common_unit": F.when(known & same_dimension, _lookup(l("dimension"), COMMON, lambda v: v[0])), "common_loq": F.when(known & same_dimension & ~hard & l("loq").isNotNull() & r("loq").isNotNull(), base / _lookup(l("dimension"), COMMON, lambda v: v[1]))}


def _hard_rules(g) -> list[tuple[Column, str]]:
    limit = F.when(g("platform_family") == "lc_ms_targeted", POLICY["cv_targeted"]).otherwise(POLICY["cv_other"])
    return [(g("qc_cv") > limit, "qc_cv_exceeds_threshold"), (g("correction_scope") == "cross_study", "cross_study_batch_correction")]


def _qaqc_rules(g) -> list[tuple[Column, str]]:
    return _hard_rules(g) + [
        (g("qc_cv").isNull(), "qc_precision_not_reported"), (_missing(g("run_order")) | g("run_randomized").isNull(), "run_order_not_documented"), (~_yes(g("pooled_qc")) | _missing(g("pooled_qc_frequency")), "pooled_qc_schedule_missing"),
        (~_yes(g("drift_evaluated")), "analytical_drift_not_evaluated"), (_yes(g("drift_evaluated")) & _missing(g("drift_method")), "drift_evaluation_method_missing"), ((g("batch_count") > 1) & _missing(g("batch_id")), "batch_identifier_missing"),
        ((g("batch_count") > 1) & (g("correction_scope") != "within_study"), "within_study_batch_processing_required"), (~_yes(g("blanks_documented")), "blank_qc_not_documented"), (_missing(g("reference_material")), "reference_material_not_documented"),
        (g("platform_family").isin(*NEEDS_STANDARD) & _missing(g("internal_standard")), "internal_standard_not_documented"),
    ]


def _qaqc() -> dict[str, Column]:
    found, hard = F.concat("l.qaqc", "r.qaqc"), F.col("l.qaqc_hard") | F.col("r.qaqc_hard")
    return {"qaqc_status": F.when(hard, "non_combinable").when(F.size(found) > 0, "requires_human_review").otherwise("accepted"), "qaqc_confidence": F.when(hard, 0.20).when(F.size(found) > 0, 0.65).otherwise(0.95), "qaqc_left": F.col("l.qaqc"), "qaqc_right": F.col("r.qaqc")}


def _verdict(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the decision of (l, r, evidence) rows: the three assessments, the worst status, clamped confidence and the
    permitted analysis; blockers of the left record, of the right one and of the pair."""
    parts_of = {**_identity(), **_quantity(), **_qaqc()}
    # staged: what follows reads each assessment several times, and would build it again each time
    rows = stage(rows.select(*keep, *[c.alias(n) for n, c in parts_of.items()]), "assessments")
    parts = [F.col(f"{p}_status") for p in ("identity", "quantity", "qaqc")]
    any_of = lambda s: reduce(lambda a, b: a | b, [p == s for p in parts])
    status = F.when(any_of("non_combinable"), "non_combinable").when(any_of("requires_human_review"), "requires_human_review").otherwise("accepted")
    own = lambda side: F.concat(*[f"{p}_{side}" for p in ("identity", "quantity", "qaqc")])
    rows = rows.withColumns({"status": status, "left_blockers": own("left"), "right_blockers": own("right"), "pair_blockers": F.array_sort(F.array_distinct(F.concat("identity_blockers", "quantity_blockers")))})
    unsafe = F.exists(F.concat("left_blockers", "right_blockers", "pair_blockers"), lambda b: reduce(lambda x, y: x | y, [F.contains(b, F.lit(d)) for d in DISQUALIFY]))
    permitted = F.when(F.col("status") == "accepted", "pooled_individual_values").when((F.col("identity_status") == "accepted") & ~unsafe, "study_specific_effects_meta_analysis").when(F.col("status") == "requires_human_review", "none_pending_review").otherwise("none")
    least = F.least("identity_confidence", "quantity_confidence", "qaqc_confidence")
    confidence = F.when(F.col("status") == "accepted", F.greatest(least, F.lit(0.90))).when(F.col("status") == "requires_human_review", F.least(least, F.lit(0.79))).otherwise(F.least(least, F.lit(0.39)))
    level = F.when(permitted == "pooled_individual_values", "pooled_values_with_study_and_platform_sensitivity_analysis").when(permitted == "study_specific_effects_meta_analysis", "study_specific_effects_random_effects_meta_analysis").otherwise("no_cross_study_combination_until_blockers_are_resolved")
    return rows.select(
        *keep, "status", permitted.alias("permitted_analysis"), confidence.alias("confidence"), "identity_status", "quantity_status", "qaqc_status", F.when(F.col("status") == "accepted", F.col("common_unit")).alias("common_unit"),
        F.when(F.col("status") == "accepted", F.col("common_loq")).alias("common_loq"), level.alias("analysis_level"), "left_blockers", "right_blockers", "pair_blockers")


#: Columns of a decision.
DECISION = ("left_id", "right_id", "status", "permitted_analysis", "confidence", "canonical_identity", "identity_status", "quantity_status", "qaqc_status", "common_unit", "common_loq", "blockers", "analysis_level")


def _named(decided: DataFrame) -> DataFrame:
    """Decisions with all blockers sorted, a record's own under its feature_id."""
    named = lambda side: F.transform(f"{side}_blockers", lambda b: F.concat(F.col(f"{side}_id"), F.lit(":"), b))
    several = F.array_sort(F.array_distinct(F.concat(named("left"), named("right"), "pair_blockers")))
    blockers = F.when((F.size("left_blockers") == 0) & (F.size("right_blockers") == 0), F.col("pair_blockers")).otherwise(several)
    return decided.withColumn("blockers", blockers).select(*DECISION)


def decide(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Per supplied pair: the three assessments, the worst status, sorted blockers, clamped confidence and the permitted
    analysis. No feature pairs with itself. :func:`decide_candidates` decides all pairs that share an identifier."""
    enforce(pairs.filter("left_id = right_id"), "a feature cannot be harmonised with itself")
    known = stage(normalised(records), "records")  # a pair reads it twice
    rows = paired(pairs, known).withColumn("_e", _evidence("l.ids", "r.ids")).select("left_id", "right_id", "l", "r", "_e.*").withColumnRenamed("identity", "canonical_identity")
    found = _named(_verdict(rows, ["left_id", "right_id", "canonical_identity"]))
    release(known)
    return found


#: Feature ids of a class in one row, and such rows on a tile's side.
CHUNK, TILE = 128, 128
_REST = [c for c in PAIRED if c not in ("feature_id", "ids")]


class Candidates:
    """All pairs of records that share an identifier, by classes of records with the same identifiers and the same rest.

    A decision depends on the feature ids only by the names in its blockers. So evidence is found once for each pair of
    identifier lists, a decision once for each kind of evidence and pair of rests, and pairs are counted by classes;
    :meth:`decisions` makes each pair of records from what was decided for its classes.
    """

    def __init__(self, records: DataFrame):
        digest = lambda columns: F.sha2(F.to_json(F.struct(*columns)), 256)
        known = stage(normalised(records).filter("feature_id is not null").withColumns({"_ids": digest(["ids"]), "_rest": digest(_REST)}), "records")
        number = F.monotonically_increasing_id()
        lists = stage(known.groupBy("_ids").agg(F.first("ids").alias("ids")).withColumn("i", number), "identifiers")
        rests = stage(known.groupBy("_rest").agg(*[F.first(c).alias(c) for c in _REST]).withColumn("rest", number), "rests")
        self.members = stage(known.select("feature_id", "_ids", "_rest").join(lists.select("_ids", "i"), "_ids").join(rests.select("_rest", "rest"), "_rest").select("feature_id", "i", "rest"), "members")
        self.rests = rests.drop("_rest")
        held = lists.select("i", F.explode("ids").alias("x")).select("i", F.concat("x.scheme", F.lit("\t"), "x.value").alias("identifier")).filter("identifier is not null")
        met = shared_pairs(held, "i", "identifier").select(F.col("left_key").alias("li"), F.col("right_key").alias("ri")).union(held.select(F.col("i").alias("li"), F.col("i").alias("ri")).distinct())
        of = lambda side: lists.select(F.col("i").alias(f"{side}i"), F.col("ids").alias(f"{side}_ids"))
        self.identities = stage(met.join(of("l"), "li").join(of("r"), "ri").select("li", "ri", _evidence("l_ids", "r_ids").alias("_e")).select("li", "ri", "_e.*"), "identities")
        release(known)

    def _classes(self, cells: DataFrame, held: str) -> DataFrame:
        """Each pair of ``cells`` (i, rest, chunk, held) whose lists are paired, once, in tiles of TILE by TILE cells."""
        sizes = cells.groupBy("i").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        of = lambda side: sizes.select(F.col("i").alias(f"{side}i"), F.col("tiles").alias(f"{side}t"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        tiles = self.identities.join(of("l"), "li").join(of("r"), "ri").withColumn("a", F.explode(upto("lt"))).withColumn("b", F.explode(upto("rt"))).filter("li <> ri or a <= b").drop("lt", "rt")
        dealt = cells.join(sizes, "i").withColumn("tile", F.pmod(F.xxhash64("rest", "chunk"), "tiles").cast("int"))
        # merged: the files' sizes say nothing of the tiles that are made of them
        cell = lambda side, tile: dealt.select(F.col("i").alias(f"{side}i"), F.col("tile").alias(tile), *[F.col(c).alias(f"{side}_{c}") for c in ("rest", "chunk", held)]).hint("merge")
        met = tiles.join(cell("l", "a"), ["li", "a"]).join(cell("r", "b"), ["ri", "b"])
        same = (F.col("li") == F.col("ri")) & (F.col("l_rest") == F.col("r_rest"))
        turned = F.col("l_rest") > F.col("r_rest")
        pick = lambda c, one, two: F.when(turned, F.col(f"{two}_{c}")).otherwise(F.col(f"{one}_{c}"))
        once = (F.col("li") != F.col("ri")) | (F.col("a") < F.col("b")) | (F.struct("l_rest", "l_chunk") <= F.struct("r_rest", "r_chunk"))
        return met.filter(once).select(*KIND, "identity", (same & (F.col("l_chunk") == F.col("r_chunk"))).alias("same"), *[pick(c, *sides).alias(f"{sides[0]}_{c}") for c in ("rest", held) for sides in (("l", "r"), ("r", "l"))])

    def _pairs(self) -> DataFrame:
        """Each pair of records, with its kind of evidence and its rests."""
        n = self.members.groupBy("i", "rest").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
        cells = self.members.join(n, ["i", "rest"]).groupBy("i", "rest", F.pmod(F.xxhash64("feature_id"), "_chunks").cast("int").alias("chunk")).agg(F.collect_list("feature_id").alias("ids"))
        return self._classes(cells, "ids")

    @staticmethod
    def _each(pairs: DataFrame) -> DataFrame:
        each = pairs.withColumn("_l", F.explode("l_ids")).withColumn("_r", F.explode("r_ids")).drop("l_ids", "r_ids")
        return each.filter((F.col("_l") < F.col("_r")) | (~F.col("same") & (F.col("_l") > F.col("_r"))))

    def counted(self) -> DataFrame:
        """A decision for each kind of evidence and pair of rests, with the number of its ``pairs``."""
        key = [*KIND, "l_rest", "r_rest"]
        if self.members.groupBy("feature_id").count().filter("count > 1").isEmpty():
            cells = self.members.groupBy("i", "rest").agg(F.count("*").alias("n")).withColumn("chunk", F.lit(0))
            l, r = F.col("l_n"), F.col("r_n")
            found = self._classes(cells, "n").groupBy(*key).agg(F.sum(F.when(F.col("same"), F.shiftright(l * (l - 1), 1)).otherwise(l * r)).alias("pairs"))
        else:  # a feature id with several records doesn't pair with itself, which numbers of records don't show
            found = self._each(self._pairs()).groupBy(*key).agg(F.count("*").alias("pairs"))
        of = lambda side: self.rests.select(F.col("rest").alias(f"{side}_rest"), F.struct(*_REST).alias(side))
        return _verdict(found.filter("pairs > 0").join(of("l"), "l_rest").join(of("r"), "r_rest"), [*key, "pairs"])

    def decisions(self) -> DataFrame:
        """A row for each pair of records, as :func:`decide` has it."""
        decided = stage(self.counted(), "decisions")
        key = [*KIND, "l_rest", "r_rest"]
        pairs = self._pairs()
        on = reduce(lambda a, b: a & b, [pairs[c].eqNullSafe(decided[c]) for c in key])
        each = self._each(pairs.join(decided.drop("pairs"), on).select("identity", "same", "l_ids", "r_ids", *[decided[c] for c in decided.columns if c not in (*key, "pairs")]))
        turned = F.col("_l") > F.col("_r")
        either = lambda one, two: F.when(turned, F.col(two)).otherwise(F.col(one))
        named = each.withColumns({
            "left_id": F.least("_l", "_r"), "right_id": F.greatest("_l", "_r"), "canonical_identity": F.col("identity"),
            "left_blockers": either("left_blockers", "right_blockers"), "right_blockers": either("right_blockers", "left_blockers"),
        })
        return _named(named)


def decide_candidates(records: DataFrame) -> DataFrame:
    """Decisions of all pairs that share an identifier."""
    return Candidates(records).decisions()


def count_candidates(records: DataFrame) -> DataFrame:
    """The same without feature ids: kinds of decisions, each with the number of its ``pairs``."""
    return Candidates(records).counted()


# Strata and diagnostics that a combination of studies must report; they are declared here, not computed.
STRATA = ("study_id", "platform_family", "assay_id", "sample_matrix")
DIAGNOSTICS = ("Cochran_Q", "I2", "tau2", "platform_moderator_meta_regression", "leave_one_study_out", "leave_one_platform_out")


def heterogeneity_plan(decisions: DataFrame) -> DataFrame:
    """Each decided pair, or kind of pairs, with the level of its analysis, what to stratify by and which diagnostics it must report."""
    constant = lambda values: F.array(*[F.lit(v) for v in values])
    own = [c for c in ("left_id", "right_id", "pairs") if c in decisions.columns]
    return decisions.select(*own, "analysis_level", constant(STRATA).alias("stratify_by"), constant(DIAGNOSTICS).alias("required_diagnostics"))


def artifacts(decisions: DataFrame) -> dict[str, DataFrame]:
    """The decisions in three tables by status; only accepted ones keep their transform. audit() has their digests."""
    parts = {"accepted": "accepted", "review": "requires_human_review", "non_combinable": "non_combinable"}
    return {name: decisions.filter(F.col("status") == status) for name, status in parts.items()}


def audit(decisions: DataFrame) -> DataFrame:
    """Per status: pairs, and a digest of their rows that their order doesn't change."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(decisions.columns)])), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]  # added up, so no row list is held
    return decisions.groupBy("status").agg(F.count("*").alias("pairs"), F.sha2(F.concat_ws("|", *sums), 256).alias("digest"))


def summary(decisions: DataFrame) -> DataFrame:
    """Pairs in all and by status, of decisions or of kinds with their ``pairs``."""
    n = F.col("pairs") if "pairs" in decisions.columns else F.lit(1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return decisions.agg(total(n).alias("pairs"), *[total(F.when(F.col("status") == s, n)).alias(s) for s in ("accepted", "requires_human_review", "non_combinable")])

"""Assay-pair, routing, ledger and gate queries on records that are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assay, evaluate, ledger
from ..registry import query, table


def assay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assay record per part; brand, type and size stand for the structure."""
    k = F.col("p_partkey")
    text = lambda v: F.lit(v)
    unit = F.when(k % 17 == 0, "mg per dL").otherwise("µmol/L")
    # dealt out: a small file is one task
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size").repartition("p_partkey").select(
        F.lpad(k.cast("string"), 12, "0").alias("feature_id"),
        F.array(F.struct(text("InChI Key").alias("scheme"), F.concat_ws("-", "p_brand", F.replace("p_type", F.lit(" "), F.lit("")), "p_size").alias("value"), F.when(k % 5 != 0, "exact_structure").otherwise("lipid_species").alias("resolution"))).alias("ids"),
        text("exact_structure").alias("resolution"), (k % 7 != 0).alias("msi_level_1"), F.lit(True).alias("authentic_standard"), F.lit(True).alias("provenance_resolved"),
        F.when(k % 11 == 0, "relative_abundance").otherwise("absolute_concentration").alias("quantitation_type"), F.when(k % 13 == 0, "log2").otherwise("linear").alias("scale"), unit.alias("unit"), F.when(k % 19 == 0, "urine").otherwise("Plasma").alias("sample_matrix"),
        text("linear").alias("calibration_model"), text("nist").alias("calibration_traceability"), text("d4").alias("internal_standard"), text("srm1950").alias("reference_material"), text("lc_ms_targeted").alias("platform_family"), text("m1").alias("method_id"),
        F.concat(F.lit("v"), k % 2).alias("assay_version"), F.when(k % 3 == 0, F.array(F.lit("b1"))).otherwise(F.array().cast("array<string>")).alias("bridges"), (k % 10 / 20.0).alias("missing_fraction"), F.lit(True).alias("missing_codes"), text("reason").alias("missing_reason"),
        F.lit(True).alias("zero_distinguished"), text("none").alias("imputation"), F.lit(True).alias("unimputed_available"), text("left_censored").alias("censoring_policy"), F.lit(True).alias("censoring_flags"), text("BLQ").alias("below_limit_code"), (1.0 + k % 3).alias("loq"), unit.alias("loq_unit"),
        (k % 25).cast("double").alias("qc_cv"), text("seq").alias("run_order"), F.lit(True).alias("run_randomized"), F.lit(True).alias("pooled_qc"), text("every 10").alias("pooled_qc_frequency"), F.lit(True).alias("drift_evaluated"), text("loess").alias("drift_method"), text("within_study").alias("correction_scope"),
        F.lit(2).alias("batch_count"), text("batch").alias("batch_id"), F.lit(True).alias("blanks_documented"),
    )


_PAIR = """
WITH pr AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
s AS (SELECT *, CASE WHEN a % 5 <> 0 AND b % 5 <> 0 AND a % 7 <> 0 AND b % 7 <> 0 THEN 'accepted' ELSE 'requires_human_review' END AS ident,
 CASE WHEN a % 11 = 0 OR b % 11 = 0 THEN 'non_combinable' WHEN a % 13 = 0 OR b % 13 = 0 OR (a % 17 = 0) <> (b % 17 = 0) THEN 'requires_human_review' WHEN (a % 19 = 0) <> (b % 19 = 0) THEN 'non_combinable'
  WHEN a % 10 > 4 OR b % 10 > 4 OR (a % 2 <> b % 2 AND NOT (a % 3 = 0 AND b % 3 = 0)) THEN 'requires_human_review' ELSE 'accepted' END AS quant,
 CASE WHEN a % 25 > 20 OR b % 25 > 20 THEN 'non_combinable' ELSE 'accepted' END AS qa FROM pr),
d AS (SELECT *, CASE WHEN 'non_combinable' IN (quant, qa) THEN 'non_combinable' WHEN 'requires_human_review' IN (ident, quant) THEN 'requires_human_review' ELSE 'accepted' END AS status FROM s)"""


@query("assay_pair_decision", _PAIR + """
, i AS (SELECT d.*, lpad(a::VARCHAR, 12, '0') AS l, lpad(b::VARCHAR, 12, '0') AS r, a % 5 <> 0 AND b % 5 <> 0 AS exact, a % 7 <> 0 AND b % 7 <> 0 AS proven, a % 11 <> 0 AND b % 11 <> 0 AS absolute, a % 13 <> 0 AND b % 13 <> 0 AS linear,
 (a % 17 = 0) = (b % 17 = 0) AS one_dimension, (a % 19 = 0) = (b % 19 = 0) AS one_matrix, a % 2 = b % 2 OR (a % 3 = 0 AND b % 3 = 0) AS methods, 'inchikey:' || upper(p_brand || '-' || replace(p_type, ' ', '') || '-' || p_size) AS canonical FROM d JOIN part ON p_partkey = a),
g AS (SELECT *, [CASE WHEN a % 10 > 4 THEN l || ':missingness_requires_sensitivity_analysis' END, CASE WHEN b % 10 > 4 THEN r || ':missingness_requires_sensitivity_analysis' END] AS gaps,
 [CASE WHEN a % 25 > 20 THEN l || ':qc_cv_exceeds_threshold' END, CASE WHEN b % 25 > 20 THEN r || ':qc_cv_exceeds_threshold' END] AS qc, [CASE WHEN NOT exact THEN 'isomer_or_stereochemistry_unresolved' END, CASE WHEN NOT proven THEN 'msi_level_1_evidence_required' END] AS who FROM i),
w AS (SELECT *, CASE WHEN NOT absolute THEN list_concat([CASE WHEN (a % 11 = 0) <> (b % 11 = 0) THEN 'quantitation_type_incompatible' ELSE 'non_absolute_values_not_poolable' END], gaps) WHEN NOT linear THEN ['nonlinear_or_unknown_scale']
  WHEN NOT one_dimension THEN ['concentration_dimension_mismatch'] WHEN NOT one_matrix THEN ['biospecimen_matrix_incompatible'] ELSE list_concat(gaps, [CASE WHEN NOT methods THEN 'unbridged_assay_methods' END]) END AS much FROM g),
c AS (SELECT *, least(CASE WHEN exact AND proven THEN 0.98 WHEN exact THEN 0.72 ELSE 0.55 END,
 CASE WHEN NOT absolute THEN 0.10 WHEN NOT linear THEN 0.45 WHEN NOT one_dimension THEN 0.35 WHEN NOT one_matrix THEN 0.10 WHEN len(list_filter(much, lambda x: x IS NOT NULL)) > 0 THEN 0.60 ELSE 0.94 END, CASE WHEN qa = 'accepted' THEN 0.95 ELSE 0.20 END) AS least FROM w)
SELECT l AS left_id, r AS right_id, status, ident AS identity_status, quant AS quantity_status, qa AS qaqc_status, canonical AS canonical_identity,
 CAST(CASE status WHEN 'accepted' THEN greatest(least, 0.90) WHEN 'requires_human_review' THEN least(least, 0.79) ELSE least(least, 0.39) END AS DOUBLE) AS confidence,
 array_to_string(list_sort(list_distinct(list_filter(list_concat(who, much, qc), lambda x: x IS NOT NULL))), ';') AS blockers,
 CASE WHEN status = 'accepted' THEN 'pooled_individual_values' WHEN ident = 'accepted' AND qa = 'accepted' THEN 'study_specific_effects_meta_analysis' WHEN status = 'requires_human_review' THEN 'none_pending_review' ELSE 'none' END AS permitted_analysis,
 CASE WHEN status = 'accepted' THEN CASE WHEN a % 17 = 0 THEN 'mg/L' ELSE 'umol/L' END END AS common_unit, CASE WHEN status = 'accepted' THEN round(greatest(1.0 + a % 3, 1.0 + b % 3) * CASE WHEN a % 17 = 0 THEN 10.0 ELSE 1.0 END, 6)::DOUBLE END AS common_loq,
 CASE WHEN status = 'accepted' THEN 'pooled_values_with_study_and_platform_sensitivity_analysis' WHEN ident = 'accepted' AND qa = 'accepted' THEN 'study_specific_effects_random_effects_meta_analysis' ELSE 'no_cross_study_combination_until_blockers_are_resolved' END AS analysis_level FROM c""")
def assay_pair_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs by shared structure, each with three assessments, all blockers, a confidence and what is permitted."""
    d = assay.decide_candidates(assay_records(spark, sf_dir))
    return d.select(
        "left_id", "right_id", "status", "identity_status", "quantity_status", "qaqc_status", "canonical_identity", "confidence", F.array_join("blockers", ";").alias("blockers"), "permitted_analysis", "common_unit",
        F.round("common_loq", 6).alias("common_loq"), "analysis_level",
    )


@query("assay_plan_summary", _PAIR + " SELECT count(*) AS pairs, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'requires_human_review') AS requires_human_review, count(*) FILTER (status = 'non_combinable') AS non_combinable FROM d")
def assay_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assay.summary(assay.count_candidates(assay_records(spark, sf_dir)))


@query("inference_ledger", """
WITH n AS (SELECT DISTINCT c_nationkey AS gene, 'R' || o_orderpriority AS reaction FROM customer JOIN orders ON o_custkey = c_custkey), rc AS (SELECT DISTINCT 'R' || o_orderpriority AS reaction, o_orderstatus AS compound FROM orders),
cn AS (SELECT 'O' AS compound, 'open' AS name UNION ALL SELECT 'F', 'filled'), ns AS (SELECT 'open' AS name, 'S1' AS study),
h AS (SELECT 'gene_to_reaction' AS hop, gene::VARCHAR AS subject, reaction AS object FROM n UNION ALL SELECT 'reaction_to_compound', reaction, compound FROM rc UNION ALL SELECT 'compound_to_name', c.compound, name FROM (SELECT DISTINCT compound FROM rc) c LEFT JOIN cn USING (compound)
 UNION ALL SELECT 'name_to_study', name, study FROM ns UNION ALL SELECT DISTINCT 'gene_to_study', gene::VARCHAR, study FROM n JOIN rc USING (reaction) JOIN cn USING (compound) JOIN ns USING (name))
SELECT hop, subject, object, CASE WHEN object IS NULL THEN 'absent_no_refmet_mapping' ELSE 'declared_by_source' END AS state, false AS is_evidence_of_absence FROM h""")
def inference_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of a four-table chain; an unmapped hop is a row, not a gap."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    gene = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("gene")).join(orders, "o_custkey").select("gene", F.concat(F.lit("R"), "o_orderpriority").alias("reaction")).distinct()
    compound = orders.select(F.concat(F.lit("R"), "o_orderpriority").alias("reaction"), F.col("o_orderstatus").alias("compound")).distinct()
    names = spark.createDataFrame([("O", "open"), ("F", "filled")], "compound string, name string")
    studies = spark.createDataFrame([("open", "S1")], "name string, study string")
    return ledger.inference_ledger(gene, compound, names, studies).select("hop", "subject", "object", "state", "is_evidence_of_absence")


@query("route_sources", """
WITH s AS (SELECT source AS source_id, count(*) AS n, list(DISTINCT lang) AS lanes FROM documents GROUP BY source), x AS (SELECT source_id, CAST(n % 10 + 20 * len(list_intersect(lanes, ['fr', 'es'])) AS BIGINT) AS score, len(list_intersect(lanes, ['fr', 'es'])) AS h FROM s),
r AS (SELECT source_id, score, row_number() OVER (ORDER BY score DESC, source_id) AS place FROM x WHERE h > 0) SELECT *, place <= 12 AS selected FROM r""")
def route_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg((F.count("*") % 10).alias("priority"), F.collect_set("lang").alias("lanes")).withColumns({"namespaces": F.array().cast("array<string>"), "is_open": F.lit(True)})
    return ledger.route(s, ["fr", "es"], []).select("source_id", "score", "place", "selected")


@query("gate_outcomes", """
SELECT lang, CASE WHEN n < 100 OR mx < 1000 THEN 'blocked' WHEN avgc > 2400 THEN 'supported' ELSE 'negative' END AS outcome, concat_ws(';', CASE WHEN n < 100 THEN 'enough_rows' END, CASE WHEN mx < 1000 THEN 'long_texts' END) AS failed
FROM (SELECT lang, count(*) AS n, max(n_chars) AS mx, avg(n_chars) AS avgc FROM documents GROUP BY lang)""")
def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("mx"), F.avg("n_chars").alias("avgc"))
    outcome, failed = ledger.gate_outcome({"enough_rows": F.col("n") >= 100, "long_texts": F.col("mx") >= 1000}, F.col("avgc") > 2400)
    return g.select("lang", outcome.alias("outcome"), failed.alias("failed"))


@query("gate_rollup", """
SELECT event_type AS gate, count(*) AS tests, count(*) FILTER (value > 0.5) AS passed, bool_and(value > 0.5) AS gate_passed FROM events GROUP BY ALL""")
def gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("gate"), F.when(F.col("value") > 0.5, "passed").otherwise("failed").alias("outcome"))
    return evaluate.gate_rollup(e, "gate", "outcome")


@query("contract_score", """
SELECT doc_id, (CAST(contains(lower(text), 'the') AND contains(lower(text), 'in') AS INT) + CAST(contains(lower(text), 'idiot') OR contains(lower(text), 'clown') AS INT)) / 2.0::DOUBLE AS score FROM documents""")
def contract_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", evaluate.contract_score(F.col("text"), ["the", "in"], ["idiot", "clown"]).alias("score"))

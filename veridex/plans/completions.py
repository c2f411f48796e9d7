"""Queries of labels, overlaps, views, strata, literature figures and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import chi2_lower_p, chi2_upper_p
from ..operators import evaluate, linalg, paired, screening, views
from ..registry import query, table
from . import analysis, rules
from .effects import CUT, event_pairs


@query("paired_effect_labels", f"""
WITH p AS (SELECT event_type, user_id, avg(value) FILTER (ts < TIMESTAMP '{CUT}') AS before, avg(value) FILTER (ts >= TIMESTAMP '{CUT}') AS after FROM events GROUP BY ALL),
c AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'control' WHEN event_type = 'error' THEN '' WHEN user_id % 2 = 0 THEN 'trained' ELSE 'control' END AS exercise_group, CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'female' END ELSE CASE WHEN user_id % 3 = 0 THEN 'male' ELSE 'female' END END AS sex FROM p WHERE before > 0 AND after > 0)
SELECT event_type, count(*) AS n_pairs, round(avg(log2(after / before)), 9) AS mean_log2fc, CASE WHEN count(DISTINCT nullif(exercise_group, '')) = 1 THEN max(nullif(exercise_group, '')) ELSE '' END AS exercise_group, CASE WHEN count(DISTINCT sex) = 1 THEN max(sex) ELSE '' END AS sex FROM c GROUP BY event_type""")
def paired_effect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects with a group and a sex only where all pairs share them."""
    t, u = F.col("event_type"), F.col("user_id")
    group = F.when(t.isin("view", "click"), "control").when(t == "error", "").when(u % 2 == 0, "trained").otherwise("control")
    sex = F.when(t == "view", F.when(u % 2 == 0, "female")).otherwise(F.when(u % 3 == 0, "male").otherwise("female"))
    changes = event_pairs(spark, sf_dir).withColumns({"exercise_group": group, "sex": sex})
    found = paired.effects(changes, ["event_type"], labels=("exercise_group", "sex"))
    return found.select("event_type", "n_pairs", F.round("mean_log2fc", 9).alias("mean_log2fc"), "exercise_group", "sex")


@query("similarity_overlap", """
WITH i AS (SELECT l_returnflag || l_linestatus AS contrast, l_suppkey % 2 AS side, CAST(l_partkey AS VARCHAR) AS k FROM lineitem WHERE l_quantity < 20), n AS (SELECT contrast, side, k, count(*) > 1 AS twice FROM i GROUP BY ALL),
o AS (SELECT contrast, side, count(*) FILTER (twice) AS ambiguous FROM n GROUP BY ALL),
j AS (SELECT a.contrast AS l, b.contrast AS r, count(*) FILTER (NOT a.twice AND NOT b.twice) AS n_overlap, count(*) FILTER (a.twice OR b.twice) AS excluded_overlap, coalesce(string_agg(k, ';' ORDER BY k) FILTER (a.twice OR b.twice), '') AS excluded_keys FROM n a JOIN n b USING (k) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL)
SELECT l AS left_contrast, r AS right_contrast, n_overlap, excluded_overlap, excluded_keys, x.ambiguous AS left_ambiguous, y.ambiguous AS right_ambiguous FROM j JOIN o x ON x.contrast = l AND x.side = 0 JOIN o y ON y.contrast = r AND y.side = 1 WHERE n_overlap >= 5""")
def similarity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two sources' contrasts share, and which keys are left out because they are ambiguous on a side."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity < 20").select(F.concat("l_returnflag", "l_linestatus").alias("contrast"), (F.col("l_suppkey") % 2).alias("side"), F.col("l_partkey").cast("string").alias("k"))
    return paired.overlap_report(rows.filter("side = 0"), rows.filter("side = 1"), "contrast", "contrast", "k")


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effect row of each part and nation, with intervals that some rows lack."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    has = s % 3 > 0
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("feature_id"), F.when(k % 2 == 0, F.concat(F.lit("F"), k % 50)).otherwise(" ").alias("canonical_feature_id"), F.concat(F.lit("C"), s % 10).alias("contrast_id"),
        (F.col("l_discount") - 0.05).alias("effect"), F.when(has, F.col("l_discount") - 0.06).alias("ci_low"), F.when(has, F.col("l_discount") - 0.04).alias("ci_high"), F.when(s % 4 == 0, "95 percent").alias("ci_semantics"))


@query("single_feature_view", f"""
SELECT l_orderkey || '-' || l_linenumber AS feature_id, 'C' || (l_suppkey % 10) AS contrast_id, round(l_discount - 0.05, 8) AS effect, l_suppkey % 3 > 0 AS has_interval, CASE WHEN l_suppkey % 4 = 0 THEN '95 percent' ELSE '{views.NO_INTERVAL}' END AS ci_semantics,
 CAST(row_number() OVER (ORDER BY 9 - l_suppkey % 10, 'C' || (l_suppkey % 10), l_orderkey || '-' || l_linenumber) AS INTEGER) AS contrast_order FROM lineitem WHERE l_partkey % 50 = 8""")
def single_feature_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature's effects in the order of their contrasts, with intervals as they are reported."""
    contrasts = spark.range(10).select(F.concat(F.lit("C"), "id").alias("contrast_id"), (9 - F.col("id")).alias("display_order"))
    found = views.single_feature(_effects(spark, sf_dir), contrasts, "F8")
    return found.select("feature_id", "contrast_id", F.round("effect", 8).alias("effect"), F.col("ci_low").isNotNull().alias("has_interval"), "ci_semantics", "contrast_order")


@query("interval_refusals", """
WITH v AS (SELECT CASE WHEN l_suppkey % 3 > 0 AND l_linenumber = 5 THEN 'half_interval' WHEN l_suppkey % 3 > 0 AND l_linenumber = 6 THEN 'ends_reversed' END AS violation FROM lineitem) SELECT violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY ALL""")
def interval_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a single-feature view would refuse, and why."""
    line = F.split("feature_id", "-")[1].cast("int")
    rows = _effects(spark, sf_dir).withColumns({"ci_low": F.when(line != 5, F.col("ci_low")), "ci_high": F.when(line == 6, F.col("ci_low") - 1).otherwise(F.col("ci_high"))})
    return views.interval_violations(rows).groupBy("violation").agg(F.count("*").alias("n"))


_STRATUM = "concat_ws(' | ', 'source_system=tpch', 'study_id=' || s_nationkey, 'species=not_reported', 'sample_matrix=' || l_linestatus, 'assay_panel=' || p_brand, 'accession_or_contrast=' || l_returnflag, 'sex_or_subgroup=not_reported')"


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    fields = {"source_system": F.lit(" tpch "), "study_id": F.col("s_nationkey"), "species": F.lit(""), "sample_matrix": F.col("l_linestatus"), "assay_panel": F.col("p_brand"), "accession_or_contrast": F.col("l_returnflag")}
    return rows.withColumn("stratum", views.stratum_value(fields))


@query("analysis_strata", f"SELECT {_STRATUM} AS stratum, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def analysis_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the seven fields of their analysis stratum."""
    return _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"))


@query("mixed_strata", f"""
WITH s AS (SELECT {_STRATUM} AS stratum, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) SELECT stratum, 'p_type' AS "column", count(DISTINCT p_type) AS "values" FROM s GROUP BY 1 HAVING count(DISTINCT p_type) <> 1""")
def mixed_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata in which a column that must have one value has several."""
    return views.mixed_strata(_strata(spark, sf_dir), "stratum", ["p_brand", "p_type"])


@query("literature_stats", rules._SCREEN + """, e AS (
 SELECT unnest(list_filter([CASE WHEN screen_class = 'screening_uncertain_insufficient_text' THEN 'unscreenable_record' END, CASE WHEN tier = 'preprint_not_peer_reviewed' THEN 'preprint_without_peer_review' END, CASE WHEN tier = 'retracted_or_retraction_notice' THEN 'retraction_flag_in_publication_type' END,
 CASE WHEN homonym <> 'no_homonym_signal' THEN 'possible_name_homonym' END, CASE WHEN screen_class = 'direct_human_exercise' AND abstract NOT LIKE '%ST003662%' THEN 'unresolved_data_deposition' END], lambda x: x IS NOT NULL)) AS escalation FROM r),
m AS (SELECT unnest([{'metric': 'record_count', 'n': count(*)}, {'metric': 'confirmed_count', 'n': count(*)}, {'metric': 'human_exercise_count', 'n': count(*) FILTER (screen_class = 'direct_human_exercise')}, {'metric': 'human_exercise_primary_count', 'n': count(*) FILTER (screen_class = 'direct_human_exercise' AND tier = 'peer_reviewed_primary')},
 {'metric': 'mechanistic_count', 'n': count(*) FILTER (screen_class = 'animal_or_invitro_mechanistic')}, {'metric': 'reviews_count', 'n': count(*) FILTER (screen_class = 'secondary_synthesis')}, {'metric': 'non_exercise_count', 'n': count(*) FILTER (screen_class = 'human_non_exercise_context')},
 {'metric': 'retracted_count', 'n': count(*) FILTER (tier = 'retracted_or_retraction_notice')}, {'metric': 'preprint_count', 'n': count(*) FILTER (tier = 'preprint_not_peer_reviewed')}, {'metric': 'human_exercise_with_accession', 'n': count(*) FILTER (screen_class = 'direct_human_exercise' AND abstract LIKE '%ST003662%')},
 {'metric': 'subject_absent', 'n': 0}, {'metric': 'no_abstract', 'n': 0}, {'metric': 'homonym_flagged', 'n': count(*) FILTER (homonym = 'flagged_non_metabolite_homonym_context')}, {'metric': 'homonym_mixed', 'n': count(*) FILTER (homonym = 'mixed_material_and_biological_context')}, {'metric': 'uncertain_total', 'n': count(*) FILTER (screen_class = 'screening_uncertain_insufficient_text')}]) AS x FROM r)
SELECT x.metric AS metric, CAST(NULL AS VARCHAR) AS value, x.n AS n FROM m UNION ALL SELECT 'year', publication_year, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'escalation', escalation, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'escalation_total', NULL, count(*) FROM e""")
def literature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of a literature section, derived from the screened records; designs are tested elsewhere."""
    return screening.literature_stats(rules.screened(spark, sf_dir), "doc_id").filter("metric <> 'replication_count'")


@query("cost_estimates", """
SELECT o_orderkey, CAST(floor(o_totalprice * 1000) AS BIGINT) AS operations, CASE o_orderkey % 3 WHEN 0 THEN 'MAX_PERMUTATION_WORK_UNITS' WHEN 1 THEN 'MAX_FEATURES_TIER_A' ELSE 'NO_SUCH_CAP' END AS cap_name, round(floor(o_totalprice * 1000) / 5000000, 6) AS estimated_seconds, CASE o_orderkey % 3 WHEN 0 THEN 3000000000 WHEN 1 THEN 20000 END AS cap_value,
 floor(o_totalprice * 1000) <= CASE o_orderkey % 3 WHEN 0 THEN 3000000000 WHEN 1 THEN 20000 END AS within_cap FROM orders""")
def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against their named caps."""
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 1000).cast("bigint").alias("operations"), F.when(k == 0, "MAX_PERMUTATION_WORK_UNITS").when(k == 1, "MAX_FEATURES_TIER_A").otherwise("NO_SUCH_CAP").alias("cap_name"))
    return linalg.cost_estimates(rows, "operations", "cap_name").withColumn("estimated_seconds", F.round("estimated_seconds", 6))


@query("chi2_both_tails", """
WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, 2 * (1 + count(*) % 9) AS df, CAST(1 + count(*) % 30 AS DOUBLE) AS x FROM lineitem GROUP BY ALL),
s AS (SELECT *, (SELECT sum(exp(k * ln(x / 2) - lgamma(k + 1))) FROM range(df // 2) t(k)) * exp(-x / 2) AS upper FROM g)
SELECT l_returnflag, l_linestatus, CAST(df AS BIGINT) AS df, x, round(upper, 9) AS upper, round(1 - upper, 9) AS lower FROM s""")
def chi2_both_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tails for different degrees of freedom; even ones, whose tail is a finite sum in SQL."""
    n = F.count("*")
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((2 * (1 + n % 9)).alias("df"), (1 + n % 30).cast("double").alias("x"))
    return g.select("l_returnflag", "l_linestatus", "df", "x", F.round(chi2_upper_p(F.col("x"), F.col("df")), 9).alias("upper"), F.round(chi2_lower_p(F.col("x"), F.col("df")), 9).alias("lower"))


@query("benchmark_disagreements", "WITH " + analysis._MAPS.replace("j AS (SELECT p.k IS NOT NULL", "j AS (SELECT k, p.k IS NOT NULL") + "," + analysis._QUALITY + """,
r AS (SELECT *, list_filter([CASE WHEN NOT inp THEN 'missing_prediction' END, CASE WHEN NOT ing THEN 'unexpected_prediction' END, CASE WHEN inp AND ing AND pc <> gc THEN 'common_variable_mismatch' END, CASE WHEN inp AND ing AND ps <> gs THEN 'review_status_mismatch' END,
 CASE WHEN inp AND ps = 'accepted' AND pc <> 'not_mapped' AND NOT coalesce(ing AND gs = 'accepted' AND pc = gc, false) THEN 'unsafe_auto_accept' END], lambda x: x IS NOT NULL) AS reasons FROM j),
w AS (SELECT q.*, psc IS NOT NULL AS inp, CASE WHEN psc IS NOT NULL AND gsc <> 'out_of_scope_non_human' THEN abs(ps - gs) END AS off FROM q),
x AS (SELECT *, list_filter([CASE WHEN NOT inp THEN 'missing_prediction' END, CASE WHEN inp AND gsc <> 'not_declared' AND gsc <> psc THEN 'scope_status_mismatch' END, CASE WHEN inp AND gsc <> 'out_of_scope_non_human' AND ps IS NULL THEN 'quality_score_not_reported' END, CASE WHEN off > 0.15 THEN 'quality_score_outside_tolerance' END], lambda x: x IS NOT NULL) AS reasons FROM w)
SELECT 'mapping' AS case_type, CAST(k AS VARCHAR) AS source_study, 'v' || k AS source_variable, coalesce(gc, pc) AS common_variable, reasons[1] AS outcome, array_to_string(reasons, ';') AS reason_codes, gc AS gold_common_variable, pc AS predicted_common_variable, gs AS gold_review_status, ps AS predicted_review_status,
 CAST(NULL AS DECIMAL(10, 6)) AS gold_overall_score, CAST(NULL AS DECIMAL(10, 6)) AS predicted_overall_score, CAST(NULL AS VARCHAR) AS gold_scope_status, CAST(NULL AS VARCHAR) AS predicted_scope_status, CAST(NULL AS DECIMAL(10, 6)) AS absolute_difference, CAST(NULL AS BOOLEAN) AS within_tolerance FROM r WHERE len(reasons) > 0
UNION ALL SELECT 'quality', CAST(k AS VARCHAR), NULL, NULL, reasons[1], array_to_string(reasons, ';'), NULL, NULL, NULL, NULL, gs, ps, gsc, psc, off, off <= 0.15 FROM x WHERE len(reasons) > 0""")
def benchmark_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mapping and quality case that isn't correct, in one table of 16 columns."""
    k = F.col("k").cast("string")
    maps = evaluate.mapping_cases(analysis.mappings(spark, sf_dir))
    return evaluate.disagreements(maps, evaluate.quality_cases(analysis.qualities(spark, sf_dir)), k, F.concat(F.lit("v"), k))

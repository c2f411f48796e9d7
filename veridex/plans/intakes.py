"""Intake queries: scopes, profiles and study records from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intake
from ..registry import query, table


@query("assay_scope_category", """
WITH s AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'targeted' WHEN l_linestatus = 'O' AND l_partkey % 50 = 0 THEN 'untargeted' ELSE 'other' END AS scope FROM lineitem)
SELECT l_suppkey, CASE WHEN bool_or(scope = 'targeted') AND bool_or(scope = 'untargeted') THEN 'both' WHEN bool_or(scope = 'targeted') THEN 'targeted' WHEN bool_or(scope = 'untargeted') THEN 'untargeted' ELSE 'other' END AS category FROM s GROUP BY ALL""")
def assay_scope_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")  # noqa: E741
    label = F.when((F.col("l_linestatus") == "O") & (F.col("l_partkey") % 50 == 0), "LC Untargeted panel").otherwise("panel")
    return intake.study_category(l.withColumn("scope", intake.assay_scope(F.when(F.col("l_returnflag") == "R", "targeted"), label)), "l_suppkey", "scope")


@query("effect_profile", """
WITH m AS (SELECT min(p_brand) AS b FROM part), j AS (SELECT l_returnflag, p_brand, p_brand = b AS hit FROM lineitem JOIN part ON p_partkey = l_partkey, m)
SELECT count(*) AS rows, count(*) FILTER (hit) AS hits, count(DISTINCT p_brand) AS features, array_to_string(list_sort(list_distinct(list(l_returnflag) FILTER (hit))), ';') AS tissues FROM j""")
def effect_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    name = part.agg(F.min("p_brand").alias("m")).first().m
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("tissue")).join(part, "p_partkey")
    return intake.effect_profile(rows, name, ["p_brand"])


@query("scope_filter", """
SELECT l_returnflag AS contrast, count(*) AS n FROM lineitem WHERE l_partkey % 3 = 0 AND l_returnflag IN ('A', 'R') GROUP BY ALL""")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 3 == 0, "Human Plasma").otherwise("muscle").alias("tissue"), F.col("l_returnflag").alias("contrast"))
    return intake.in_scope(rows, "blood", contrasts=["A", "R"]).groupBy("contrast").agg(F.count("*").alias("n"))


@query("standards_removed", "SELECT count(*) AS n FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0")
def standards_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "Alanine-d4").when(k % 7 == 0, "ISTD mix").otherwise("Lactic acid")
    return intake.without_standards(table(spark, sf_dir, "part").select(name.alias("name")), "name").agg(F.count("*").alias("n"))


@query("study_intake", """
WITH a AS (SELECT l_suppkey AS study_id, string_agg(DISTINCT l_shipmode, '; ' ORDER BY l_shipmode) AS p, count(DISTINCT l_linenumber) AS analyses FROM (SELECT l_suppkey, 'mode' || l_linenumber AS l_shipmode, l_linenumber FROM lineitem) GROUP BY ALL),
f AS (SELECT l_suppkey AS study_id, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS m, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL)
SELECT s_suppkey AS study_id, coalesce(p, 'unknown') AS assay_platform, coalesce(m, 'unknown') AS sample_matrix, n AS sample_size, analyses, s_suppkey % 2 = 0 AS exercise, s_suppkey % 2 = 1 AS diet FROM supplier LEFT JOIN a ON a.study_id = s_suppkey LEFT JOIN f ON f.study_id = s_suppkey""")
def study_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, analyses and factors of a study as one record with modality flags from its text."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("study_id"), "l_linenumber", "l_returnflag", "l_orderkey")  # noqa: E741
    summaries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study_id"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 2 == 0, "endurance running").otherwise("diet and food intake").alias("summary"))
    analyses = l.select("study_id", F.concat(F.lit("mode"), "l_linenumber").alias("analysis_summary"), F.col("l_linenumber").alias("analysis_id"))
    factors = l.select("study_id", F.col("l_returnflag").alias("sample_source"), F.col("l_orderkey").alias("sample_id"), F.lit("Arm:x | Visit:y").alias("factors"))
    return intake.study_records(summaries, analyses, factors).select("study_id", "assay_platform", "sample_matrix", "sample_size", "analyses", "exercise", "diet")


@query("sample_map", """
SELECT user_id % 5 AS grp, CASE user_id % 3 WHEN 0 THEN 'pre' WHEN 1 THEN 'post' ELSE 'unknown' END AS timepoint, CASE WHEN user_id % 2 = 0 THEN 'female' ELSE 'not_reported' END AS sex, count(DISTINCT user_id) AS participants FROM events GROUP BY ALL""")
def sample_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    samples = table(spark, sf_dir, "events").select(u, F.concat(F.lit("P_"), u, F.lit("_"), F.col("event_id") % 3).alias("sample_id"), F.when(u % 3 == 0, "Before exercise").when(u % 3 == 1, "After").otherwise("x").alias("collection_point"), F.when(u % 2 == 0, "female").alias("sex"))
    m = intake.sample_map(samples)
    return m.groupBy((F.regexp_extract("participant", r"(\d+)", 1).cast("bigint") % 5).alias("grp"), "timepoint", "sex").agg(F.count_distinct("participant").alias("participants"))


@query("name_matches", """
SELECT count(*) FILTER (lower(p_name) = lower((SELECT min(p_name) FROM part))) AS exact, count(*) FILTER (contains(lower(p_name), '1') AND lower(p_name) <> lower((SELECT min(p_name) FROM part))) AS inside FROM part""")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by id, exact name or substring, in that order."""
    from ..operators.views import match_search

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name")
    least = part.agg(F.min("p_name").alias("m")).first().m
    exact = match_search(part, "", least, "id", ["p_name"]).agg(F.count_if(F.col("match_kind") == "exact_name").alias("exact"))
    inside = match_search(part.filter(F.lower("p_name") != least.lower()), "", "1", "id", ["p_name"]).agg(F.count_if(F.col("match_kind") == "substring").alias("inside"))
    return exact.join(inside)  # one row each


@query("feature_identity", """
SELECT CASE WHEN p_partkey % 3 = 0 THEN p_type || ' [label: NA]' WHEN p_partkey % 3 = 1 THEN p_name ELSE p_name || ' [refmet: ' || p_type || ']' END AS feature, count(*) AS n FROM part GROUP BY ALL""")
def feature_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    label = F.when(k == 0, "NA").otherwise(F.col("p_name"))
    name = F.when(k == 1, "").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").groupBy(X.feature_identity(label, name).alias("feature")).agg(F.count("*").alias("n"))

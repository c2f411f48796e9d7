"""Paired differential queries on the driver's tables: users of events, customers of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.kernels import sign_test_fraction, sign_test_p
from ..operators import paired
from ..operators.bh import adjust
from ..registry import query, table
from .oracle_kit import bh, t_pvalue

CUT = "2024-01-16"
ALPHA, THRESHOLD = 0.05, 0.01


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value before and after the cut per event type and user, as log2 change; equal means have none, whatever the order of the rows."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "value")
    before = F.col("ts") < F.lit(CUT).cast("timestamp")
    return paired.with_change(paired.pairs(events, ["event_type"], "user_id", before, ~before, "value", combine=stats.steady_avg))


_PAIRS = f"""
pairs AS (
  SELECT event_type, user_id, avg(value) FILTER (ts < TIMESTAMP '{CUT}') AS before, avg(value) FILTER (NOT ts < TIMESTAMP '{CUT}') AS after FROM events GROUP BY ALL
),
changes AS (SELECT *, CASE WHEN before > 0 AND after > 0 THEN log2(after / before) END AS log2fc FROM pairs)"""

_EVENT_EFFECTS = f"""
WITH RECURSIVE {_PAIRS},
grouped AS (SELECT event_type, count(*) AS n, avg(log2fc) AS mean, stddev_samp(log2fc) AS sd, avg(before) AS mean_pre, avg(after) AS mean_post FROM changes WHERE log2fc IS NOT NULL GROUP BY ALL),
{t_pvalue('grouped', 'event_type')},
adjusted AS ({bh('tested')}),
chosen AS (SELECT *, CASE WHEN q_value <= {ALPHA} AND mean >= {THRESHOLD} THEN 'higher' WHEN q_value <= {ALPHA} AND mean <= -{THRESHOLD} THEN 'lower' WHEN q_value <= {ALPHA} THEN 'significant_below_threshold' ELSE 'not_selected' END AS selection FROM adjusted)
"""


def event_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjust(paired.effects(event_pairs(spark, sf_dir), ["event_type"]))
    return found.withColumn("selection", paired.selection(F.col("q_value"), F.col("mean_log2fc"), ALPHA, THRESHOLD))


@query("paired_effect_bh", _EVENT_EFFECTS + """
SELECT event_type, n AS n_pairs, round(mean, 9) AS mean_log2fc, round(mean_pre, 6) AS mean_pre, round(mean_post, 6) AS mean_post, round(p_value, 9) AS p_value, round(q_value, 9) AS q_value,
  selection, CASE WHEN mean > 0 THEN 'up' WHEN mean < 0 THEN 'down' WHEN mean = 0 THEN 'no_change' ELSE 'orientation_unknown' END AS direction
FROM chosen""")
def paired_effect_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: paired before/after effects per event type with BH q-values and selection."""
    e = event_effects(spark, sf_dir)
    return e.select("event_type", "n_pairs", F.round("mean_log2fc", 9).alias("mean_log2fc"), F.round("mean_pre", 6).alias("mean_pre"), F.round("mean_post", 6).alias("mean_post"),
                    F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"), "selection", paired.direction(F.col("mean_log2fc")).alias("direction"))


@query("volcano_display", _EVENT_EFFECTS + f"""
SELECT event_type, selection, round(-log10(greatest(p_value, 1e-300)), 6) AS neg_log10_p,
  row_number() OVER (ORDER BY CASE selection WHEN 'higher' THEN 1 WHEN 'lower' THEN 2 WHEN 'significant_below_threshold' THEN 3 WHEN 'not_selected' THEN 4 ELSE 5 END, q_value NULLS LAST, abs(mean) DESC NULLS LAST, lower(event_type), event_type) AS display_rank
FROM chosen""")
def volcano_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volcano table in display order."""
    e = paired.display_order(event_effects(spark, sf_dir).withColumn("feature", F.col("event_type")))
    return e.select("event_type", "selection", F.round(stats.neg_log10(F.col("p_value")), 6).alias("neg_log10_p"), "display_rank")


@query("volcano_topk", _EVENT_EFFECTS + """
SELECT event_type, round(p_value, 9) AS p_value FROM chosen ORDER BY p_value, event_type LIMIT 3""")
def volcano_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the three strongest effects: a top-k report, one TakeOrderedAndProject."""
    return event_effects(spark, sf_dir).orderBy("p_value", "event_type").limit(3).select("event_type", F.round("p_value", 9).alias("p_value"))


ORDER_CUT = "1996-01-01"


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price of customers before and after the cut, by priority, within market segments."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    before = F.col("o_orderdate") < F.lit(ORDER_CUT).cast("timestamp")
    changes = paired.with_change(paired.pairs(orders, ["o_orderpriority"], "o_custkey", before, ~before, "o_totalprice"), exact=True)
    return changes.filter("log2fc is not null").join(customers, "o_custkey")


_ORDER_CHANGES = f"""
opairs AS (SELECT o_orderpriority, o_custkey, avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '{ORDER_CUT}') AS before, avg(o_totalprice) FILTER (NOT o_orderdate < TIMESTAMP '{ORDER_CUT}') AS after FROM orders GROUP BY ALL),
ochanges AS (SELECT p.*, ln(after / before) / ln(2) AS log2fc, c_mktsegment FROM opairs p JOIN customer ON c_custkey = o_custkey WHERE before > 0 AND after > 0),
ostrata AS (SELECT 'all' AS stratum, * FROM ochanges UNION ALL SELECT c_mktsegment, * FROM ochanges WHERE c_mktsegment IS NOT NULL)"""


@query("paired_effect_by_stratum", f"""
WITH RECURSIVE {_ORDER_CHANGES},
grouped AS (SELECT stratum, o_orderpriority, count(*) AS n, avg(log2fc) AS mean, stddev_samp(log2fc) AS sd FROM ostrata GROUP BY ALL HAVING count(*) >= 3),
{t_pvalue('grouped', 'stratum, o_orderpriority')},
adjusted AS ({bh('tested', by='stratum')})
SELECT stratum, o_orderpriority, n AS n_pairs, round(mean, 9) AS mean_log2fc, round(p_value, 9) AS p_value, round(q_value, 9) AS q_value FROM adjusted""")
def paired_effect_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects for all customers and each segment, at least three pairs, q-values within the stratum."""
    e = adjust(paired.effects(paired.strata(order_changes(spark, sf_dir), "c_mktsegment"), ["stratum", "o_orderpriority"], min_pairs=3), by=["stratum"])
    return e.select("stratum", "o_orderpriority", "n_pairs", F.round("mean_log2fc", 9).alias("mean_log2fc"), F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"))


@query("between_group_contrasts", f"""
WITH RECURSIVE {_ORDER_CHANGES},
grouped AS (SELECT o_orderpriority, c_mktsegment, count(*) AS n, avg(log2fc) AS mean, stddev_samp(log2fc) AS sd FROM ochanges GROUP BY ALL HAVING count(*) >= 3),
{t_pvalue('grouped', 'o_orderpriority, c_mktsegment')},
adjusted AS ({bh('tested', by='c_mktsegment')}),
wanted(a, b) AS (VALUES ('BUILDING', 'MACHINERY'), ('AUTOMOBILE', 'MACHINERY'), ('BUILDING', 'AUTOMOBILE'))
SELECT l.o_orderpriority, a || '-' || b AS contrast, round(l.mean - r.mean, 8) AS effect_difference, round(greatest(l.p_value, r.p_value), 9) AS p_max, round(greatest(l.q_value, r.q_value), 9) AS q_max, false AS is_inference
FROM wanted JOIN adjusted l ON l.c_mktsegment = a JOIN adjusted r ON r.c_mktsegment = b AND r.o_orderpriority = l.o_orderpriority""")
def between_group_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between groups of one feature, from one aggregation."""
    e = adjust(paired.effects(order_changes(spark, sf_dir), ["o_orderpriority", "c_mktsegment"], min_pairs=3), by=["c_mktsegment"]).withColumn("input_order", F.lit(1))
    wanted = (("BUILDING", "MACHINERY"), ("AUTOMOBILE", "MACHINERY"), ("BUILDING", "AUTOMOBILE"))
    found = paired.between_groups(e, ["o_orderpriority"], "c_mktsegment", "input_order", wanted)
    return found.select("o_orderpriority", "contrast", F.round("effect_difference", 8).alias("effect_difference"), F.round("p_max", 9).alias("p_max"), F.round("q_max", 9).alias("q_max"), "is_inference")


@query("single_feature_effect", f"""
WITH RECURSIVE {_ORDER_CHANGES},
grouped AS (SELECT stratum, count(*) AS n, avg(log2fc) AS mean, stddev_samp(log2fc) AS sd FROM ostrata WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
{t_pvalue('grouped', 'stratum')}
SELECT stratum, n AS n_pairs, round(mean, 9) AS mean_log2fc, round(p_value, 9) AS p_value, row_number() OVER (ORDER BY mean DESC, stratum) AS effect_rank FROM tested""")
def single_feature_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature across strata, ranked by effect. The filter on the feature is pushed to the scan."""
    e = paired.effects(paired.strata(order_changes(spark, sf_dir).filter(F.col("o_orderpriority") == "1-URGENT"), "c_mktsegment"), ["stratum"])
    rank = F.row_number().over(Window.orderBy(F.desc("mean_log2fc"), "stratum")).cast("bigint")  # a row for each stratum
    return e.select("stratum", "n_pairs", F.round("mean_log2fc", 9).alias("mean_log2fc"), F.round("p_value", 9).alias("p_value"), rank.alias("effect_rank"))


@query("paired_ci", _EVENT_EFFECTS + """
, wide AS (SELECT event_type, n, mean, sd / sqrt(n) AS se FROM chosen)
SELECT event_type, n AS n_pairs, round(mean, 6) AS effect, mean - 1.9 * se < mean AS has_interval FROM wide""")
def paired_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an interval can be recovered from effect, p and n alone."""
    e = event_effects(spark, sf_dir)
    low, _ = stats.paired_ci(F.col("mean_log2fc"), F.col("p_value"), F.col("n_pairs"))
    return e.select("event_type", "n_pairs", F.round("mean_log2fc", 6).alias("effect"), (low < F.col("mean_log2fc")).alias("has_interval"))


@query("paired_ci_bounds")
def paired_ci_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95% intervals; DuckDB has no t quantile, tests compare with the standard error."""
    e = event_effects(spark, sf_dir)
    low, high = stats.paired_ci(F.col("mean_log2fc"), F.col("p_value"), F.col("n_pairs"))
    return e.select("event_type", F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


@query("sign_test", f"""
WITH {_PAIRS},
c AS (SELECT event_type, count(*) AS complete_pairs, count(*) FILTER (log2fc > 0) AS positives, count(*) FILTER (log2fc < 0) AS negatives, count(*) FILTER (log2fc = 0) AS ties, avg(log2fc) AS mean FROM changes WHERE log2fc IS NOT NULL GROUP BY ALL)
SELECT event_type, complete_pairs, positives, negatives, ties, round(mean, 9) AS mean_log2fc, round(pow(2, mean), 9) AS geometric_fold,
  round((SELECT least(1.0, 2 * sum(exp(lgamma(positives + negatives + 1) - lgamma(k + 1) - lgamma(positives + negatives - k + 1) - (positives + negatives) * ln(2)))) FROM range(least(positives, negatives) + 1) t(k)), 8) AS p_value
FROM c""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete pairs, signs, geometric fold and the exact two-sided sign test."""
    c = event_pairs(spark, sf_dir).filter("log2fc is not null").groupBy("event_type").agg(
        F.count("*").alias("complete_pairs"), F.count_if(F.col("log2fc") > 0).alias("positives"), F.count_if(F.col("log2fc") < 0).alias("negatives"), F.count_if(F.col("log2fc") == 0).alias("ties"), F.avg("log2fc").alias("_m"))
    return c.select("event_type", "complete_pairs", "positives", "negatives", "ties", F.round("_m", 9).alias("mean_log2fc"), F.round(F.pow(F.lit(2.0), F.col("_m")), 9).alias("geometric_fold"), F.round(sign_test_p(F.col("positives"), F.col("negatives")), 8).alias("p_value"))


@query("sign_test_exact")
def sign_test_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign test's p as a reduced fraction of exact integers."""
    c = event_pairs(spark, sf_dir).filter("log2fc is not null").groupBy("event_type").agg(F.count_if(F.col("log2fc") > 0).alias("positives"), F.count_if(F.col("log2fc") < 0).alias("negatives"))
    return c.withColumn("p_fraction", sign_test_fraction("positives", "negatives"))


@query("participant_response", f"""
WITH {_PAIRS}
SELECT event_type, CASE WHEN before > 0 AND after > 0 THEN CASE WHEN after > before THEN 'increased' WHEN after < before THEN 'decreased' ELSE 'unchanged' END ELSE 'incomplete_pair' END AS response, count(*) AS participants FROM changes GROUP BY ALL""")
def participant_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many participants of each feature went up or down; incomplete pairs are counted, not dropped."""
    p, before, after = event_pairs(spark, sf_dir), F.col("before"), F.col("after")
    complete = (before > 0) & (after > 0)  # log2fc is also NULL where the fold is under the least double
    response = F.when(complete, F.when(after > before, "increased").when(after < before, "decreased").otherwise("unchanged")).otherwise("incomplete_pair")
    return p.groupBy("event_type", response.alias("response")).agg(F.count("*").alias("participants"))


_SIM = """
eff AS (SELECT n_regionkey AS region, s_nationkey AS nation, p_brand AS feature, round(avg(l_discount) - 0.05, 8) AS effect FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
l AS (SELECT nation AS left_contrast, feature, effect FROM eff WHERE region <= 1), r AS (SELECT nation AS right_contrast, feature, effect FROM eff WHERE region >= 2),
j AS (SELECT left_contrast, right_contrast, count(*) AS n_overlap, coalesce(CASE WHEN isnan(corr(l.effect, r.effect)) THEN 0 ELSE corr(l.effect, r.effect) END, 0) AS pearson_r, avg(CASE WHEN l.effect * r.effect > 0 THEN 1.0 ELSE 0.0 END) AS concordance FROM l JOIN r USING (feature) GROUP BY ALL HAVING count(*) >= 5)"""


@query("similarity_ranking", f"""
WITH {_SIM}
SELECT left_contrast, right_contrast, n_overlap, round(pearson_r, 8) AS pearson_r, round(concordance, 8) AS concordance, round(.45 * greatest(pearson_r, 0) + .35 * concordance + .20 * least(n_overlap / 25.0, 1.0), 8) AS score FROM j""")
def similarity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast pairs of two sources by similarity of their effects."""
    supplier = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    eff = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("n_regionkey", F.col("s_nationkey").alias("nation"), "p_brand").agg(F.round(F.avg("l_discount") - 0.05, 8).alias("effect"))
    s = paired.similarity(eff.filter("n_regionkey <= 1"), eff.filter("n_regionkey >= 2"), "nation", "nation", "p_brand", "effect")
    return s.select("left_contrast", "right_contrast", "n_overlap", F.round("pearson_r", 8).alias("pearson_r"), F.round("concordance", 8).alias("concordance"), F.round("score", 8).alias("score"))

"""View, enrichment, evaluation and linear-algebra queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import chi2_upper_p, f_upper_p, fisher_right_p, mann_whitney_two_sided_p
from ..functions.stats import ratio
from ..operators import evaluate, linalg, views
from ..operators.bh import adjust_global
from ..operators.relational import dimension, union_of_keys
from ..registry import query, table
from .oracle_kit import betainc_cte, bh

_ITEMS = """
items AS (SELECT l_orderkey, l_linenumber, l_returnflag, p_brand, p_type, p_size, p_name, (l_discount - 0.05) AS effect, (l_partkey % 97 + 1) / 98.0 * CASE WHEN p_size < 10 THEN 0.3 ELSE 1.0 END AS p_value,
  CASE WHEN p_partkey % 10 = 0 THEN 'proposed' ELSE 'accepted' END AS mapping_status, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'curated' END AS annotation_status, (l_partkey % 30) / 100.0 AS missing_fraction, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE (l_suppkey % 25) / 100.0 END AS below_lod_fraction
 FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_discount")  # noqa: E741
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    return l.join(p, F.col("p_partkey") == k).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "p_brand", "p_type", "p_size", "p_name", (F.col("l_discount") - 0.05).alias("effect"), ((k % 97 + 1) / 98.0 * F.when(F.col("p_size") < 10, 0.3).otherwise(1.0)).alias("p_value"),
        F.when(k % 10 == 0, "proposed").otherwise("accepted").alias("mapping_status"), F.when(k % 7 != 0, "curated").alias("annotation_status"), (k % 30 / 100.0).alias("missing_fraction"), F.when(s % 4 != 0, s % 25 / 100.0).alias("below_lod_fraction"))


@query("class_enrichment", f"""
WITH {_ITEMS}, c AS (SELECT l_returnflag, p_type, count(*) AS class_rows, count(*) FILTER (p_value < 0.05) AS class_significant FROM items GROUP BY ALL),
t AS (SELECT *, CAST(sum(class_rows) OVER (PARTITION BY l_returnflag) AS BIGINT) AS background_rows, CAST(sum(class_significant) OVER (PARTITION BY l_returnflag) AS BIGINT) AS background_significant FROM c),
f AS (SELECT *, (SELECT sum(exp(lgamma(background_rows - class_rows + 1) - lgamma(background_significant - k + 1) - lgamma(background_rows - class_rows - background_significant + k + 1) + lgamma(class_rows + 1) - lgamma(k + 1) - lgamma(class_rows - k + 1)
   - lgamma(background_rows + 1) + lgamma(background_significant + 1) + lgamma(background_rows - background_significant + 1))) FROM range(class_significant, least(class_rows, background_significant) + 1) r(k)) AS p FROM t),
q AS ({bh('f', p='p', by='l_returnflag')})
SELECT l_returnflag, p_type, class_rows, class_significant, background_rows, background_significant, round((class_significant / class_rows) / (background_significant / background_rows), 8) AS enrichment_ratio, round(p, 7) AS p_value, round(q_value, 7) AS q_value FROM q""")
def class_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes enriched in significant rows of their stratum; exact hypergeometric tail, q over all classes."""
    e = views.enrichment(items(spark, sf_dir), "l_returnflag", "p_type", F.col("p_value") < 0.05, "effect", "p_value", "p_name")
    return e.select("l_returnflag", "p_type", "class_rows", "class_significant", "background_rows", "background_significant", F.round("enrichment_ratio", 8).alias("enrichment_ratio"), F.round("p_value", 7).alias("p_value"), F.round("q_value", 7).alias("q_value"))


@query("enrichment_all_lines", """
WITH r AS (SELECT l_returnflag, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT count(*) AS total FROM r),
d AS (SELECT l_returnflag, count(*) AS drawn FROM r GROUP BY 1), m AS (SELECT p_brand, count(*) AS marked FROM r GROUP BY 1), h AS (SELECT l_returnflag, p_brand, count(*) AS hits FROM r GROUP BY ALL)
SELECT l_returnflag, p_brand, hits, drawn, marked, total, round((SELECT sum(exp(lgamma(total - marked + 1) - lgamma(drawn - k + 1) - lgamma(total - marked - drawn + k + 1) + lgamma(marked + 1) - lgamma(k + 1) - lgamma(marked - k + 1)
  - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1))) FROM range(hits, least(marked, drawn) + 1) t(k) WHERE drawn - k <= total - marked), 6) AS p_value FROM h JOIN d USING (l_returnflag) JOIN m USING (p_brand), n""")
def enrichment_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands enriched among lines of each return flag: classes as large as the table."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    hits = rows.groupBy("l_returnflag", "p_brand").agg(F.count("*").alias("hits"))  # a few rows: margins come from them
    margin = lambda *by: F.sum("hits").over(Window.partitionBy(*by))
    told = hits.withColumns({"drawn": margin("l_returnflag"), "marked": margin("p_brand"), "total": margin()})
    return told.withColumn("p_value", F.round(fisher_right_p(F.col("hits"), F.col("drawn"), F.col("marked"), F.col("total")), 6))


@query("enrichment_label_filter", f"""
WITH {_ITEMS}, c AS (SELECT l_returnflag, p_type, count(*) FILTER (p_value < 0.05) AS class_significant, count(*) FILTER (p_value < 0.05 AND effect > 0) AS up_significant FROM items GROUP BY ALL)
SELECT l_returnflag, p_type, class_significant, up_significant FROM c WHERE p_type = (SELECT min(p_type) FROM part)""")
def enrichment_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label is chosen after adjustment: the filter stays above the window."""
    wanted = table(spark, sf_dir, "part").agg(F.min("p_type").alias("m")).first().m
    e = views.enrichment(items(spark, sf_dir), "l_returnflag", "p_type", F.col("p_value") < 0.05, "effect", "p_value", "p_name")
    return e.filter(F.col("p_type") == wanted).select("l_returnflag", "p_type", "class_significant", "up_significant")


_HIER = f"""
WITH {_ITEMS}, w AS (SELECT *, CASE WHEN mapping_status <> 'accepted' THEN 'mapping' WHEN annotation_status IS NULL THEN 'annotation' WHEN missing_fraction > 0.20 THEN 'missingness' WHEN below_lod_fraction > 0.20 THEN 'lod' WHEN effect IS NULL THEN 'no_effect' END AS why FROM items),
l AS (SELECT 'p_brand' AS level, p_brand AS category, * FROM w UNION ALL SELECT 'p_type', p_type, * FROM w),
g AS (SELECT level, category, l_returnflag, count(effect) FILTER (why IS NULL) AS observed, CAST(quantile_cont(effect, 0.5) FILTER (why IS NULL) AS DOUBLE) AS median, CAST(quantile_cont(effect, 0.25) FILTER (why IS NULL) AS DOUBLE) AS q1, count(*) FILTER (why IS NULL AND effect > 0) AS up, count(*) FILTER (why IS NULL AND effect < 0) AS down,
 count(*) FILTER (why = 'mapping') AS excluded_mapping, count(*) FILTER (why = 'annotation') AS excluded_annotation, count(*) FILTER (why = 'missingness') AS excluded_missingness, count(*) FILTER (why = 'lod') AS excluded_lod FROM l GROUP BY ALL),
x AS (SELECT 'p_brand' AS level, p_brand AS category, count(*) * 20 AS expected FROM part GROUP BY 2)"""


@query("hierarchy_rollup", _HIER + """
SELECT level, category, l_returnflag, observed, expected, round(median, 8) AS median, round(q1, 8) AS q1, up, down, excluded_mapping, excluded_annotation, excluded_missingness, excluded_lod,
 CASE WHEN observed < 3 THEN 'insufficient_feature_count' WHEN expected IS NULL THEN 'coverage_denominator_unknown' WHEN observed / expected < 0.05 THEN 'insufficient_coverage' ELSE 'eligible_descriptive_summary' END AS status FROM g LEFT JOIN x USING (level, category)""")
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels in one pass, coverage against a declared universe where there is one."""
    universe = table(spark, sf_dir, "part").groupBy(F.lit("p_brand").alias("level"), F.col("p_brand").alias("category")).agg((F.count("*") * 20).alias("expected"))
    h = views.hierarchy(items(spark, sf_dir), ["p_brand", "p_type"], "l_returnflag", "effect", F.col("p_value") < 0.05, universe, min_coverage=0.05)
    return h.select("level", "category", "l_returnflag", "observed", "expected", F.round("median", 8).alias("median"), F.round("q1", 8).alias("q1"), "up", "down", "excluded_mapping", "excluded_annotation", "excluded_missingness", "excluded_lod", "status")


@query("effect_heatmap_grid", """
WITH c AS (SELECT p_brand AS feature, l_returnflag || l_linestatus AS contrast, avg(l_discount) AS effect, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
m AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'proposed' ELSE 'accepted' END AS mapping_status, (n % 30) / 100.0 AS missing_fraction FROM c),
g AS (SELECT * FROM (SELECT DISTINCT feature FROM m), (SELECT DISTINCT contrast FROM m))
SELECT feature, contrast, CASE WHEN n IS NULL THEN 'not_reported' WHEN mapping_status <> 'accepted' THEN 'unreviewed_harmonization' WHEN effect IS NULL THEN 'effect_not_reported' WHEN missing_fraction > 0.20 THEN 'high_missingness' ELSE 'observed' END AS cell_status,
 CASE WHEN mapping_status = 'accepted' THEN round(effect, 8) END AS value FROM g LEFT JOIN m USING (feature, contrast)""")
def effect_heatmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete feature x contrast grid with a status in every cell."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat("l_returnflag", "l_linestatus").alias("contrast"), "l_discount").join(part, "p_partkey")
    c = c.groupBy(F.col("p_brand").alias("feature"), "contrast").agg(F.round(F.avg("l_discount"), 8).alias("effect"), F.count("*").alias("n"))
    c = c.withColumns({"mapping_status": F.when(F.col("n") % 5 == 0, "proposed").otherwise("accepted"), "missing_fraction": F.col("n") % 30 / 100.0, "below_lod_fraction": F.lit(0.0), "canonical_feature_id": F.col("feature")})
    return views.heatmap(c, "feature", "contrast", "effect", several_datasets=True)


@query("pivot_display", """
SELECT p_brand, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def pivot_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid as a matrix; the columns are named, so no pass looks for them."""
    j = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_quantity"), 6))


@query("trajectory_summary", """
WITH v AS (SELECT o_orderpriority AS grp, 'm' || month(o_orderdate) AS timepoint, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS value, 30000.0 AS lod, o_orderkey % 17 = 0 AS flagged FROM orders),
l AS (SELECT *, coalesce(flagged, false) OR coalesce(value < lod, false) AS low FROM v)
SELECT grp, timepoint, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(*) FILTER (low) AS n_below_lod, count(value) FILTER (NOT low) AS n_used, round(avg(value) FILTER (NOT low), 5) AS mean, round(stddev_samp(value) FILTER (NOT low), 5) AS sd,
 round(stddev_samp(value) FILTER (NOT low) / sqrt(count(value) FILTER (NOT low)), 6) AS se, round(CAST(quantile_cont(value, 0.5) FILTER (NOT low) AS DOUBLE), 5) AS median FROM l GROUP BY ALL""")
def trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.concat(F.lit("m"), F.month("o_orderdate")).alias("timepoint"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("value"), (F.col("o_orderkey") % 17 == 0).alias("flagged"))
    t = views.trajectory(o, "grp", "timepoint", "value", F.lit(30000.0), F.col("flagged"))
    return t.select("grp", "timepoint", "n", "n_missing", "n_below_lod", "n_used", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round("se", 6).alias("se"), F.round("median", 5).alias("median"))


@query("quality_flags", f"""WITH {_ITEMS} SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN missing_fraction > 0.20 THEN 'high_missingness' END, CASE WHEN below_lod_fraction IS NULL THEN 'below_lod_not_reported' WHEN below_lod_fraction > 0.20 THEN 'high_below_lod' END) AS flags FROM items""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(views.quality_flags(F.col("missing_fraction"), F.col("below_lod_fraction")), ";").alias("flags"))


_SCORED = "WITH s AS (SELECT doc_id, lang, quality, toxic, ln(1 + n_chars) / 10 AS score FROM documents JOIN labels USING (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", (F.log1p("n_chars") / 10).alias("score")).join(table(spark, sf_dir, "labels"), "doc_id")


@query("confusion_rates", _SCORED + """
SELECT lang, count(*) FILTER (quality = 1 AND score >= .7) AS tp, count(*) FILTER (quality = 1 AND score < .7) AS fn, count(*) FILTER (quality = 0 AND score < .7) AS tn, count(*) FILTER (quality = 0 AND score >= .7) AS fp,
 round(count(*) FILTER ((quality = 1) = (score >= .7)) / CAST(count(*) AS DOUBLE), 8) AS accuracy, round(count(*) FILTER (quality = 1 AND score >= .7) / nullif(CAST(count(*) FILTER (quality = 1) AS DOUBLE), 0), 8) AS sensitivity FROM s GROUP BY ALL""")
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluate.confusion(scored(spark, sf_dir), F.col("quality") == 1, F.col("score") >= 0.7, ["lang"])
    return c.select("lang", "tp", "fn", "tn", "fp", F.round("accuracy", 8).alias("accuracy"), F.round("sensitivity", 8).alias("sensitivity"))


@query("auroc_ranksum", _SCORED + """
, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s), a AS (SELECT sum(rk) FILTER (quality = 1) AS rs, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM r)
SELECT n1 AS positives, n0 AS negatives, round((rs - n1 * (n1 + 1) / 2.0) / (n1 * n0), 9) AS auroc FROM a""")
def auroc_ranksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auroc(scored(spark, sf_dir), F.col("quality") == 1, "score").select("positives", "negatives", F.round("auroc", 9).alias("auroc"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, label, feature, x) of two classes of embeddings; every seventh value of odd keys is unknown."""
    e = table(spark, sf_dir, "embeddings").filter("label in (0, 1)")
    long = e.select(F.col("vec_id").alias("key"), "label", F.posexplode("embedding").alias("feature", "x"))
    return long.withColumn("x", F.when(~((F.col("key") % 2 == 1) & (F.col("feature") % 7 == 0)), F.col("x").cast("double")))


_LONG = """
long AS (SELECT vec_id AS key, label, i - 1 AS feature, CASE WHEN NOT (vec_id % 2 = 1 AND (i - 1) % 7 = 0) THEN CAST(embedding[i] AS DOUBLE) END AS x FROM embeddings, range(1, 65) t(i) WHERE label IN (0, 1)),
st AS (SELECT feature, avg(x) AS centre, avg(x) FILTER (label = 0) AS m0, avg(x) FILTER (label = 1) AS m1, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, var_pop(x) FILTER (label = 0) AS v0, var_pop(x) FILTER (label = 1) AS v1 FROM long GROUP BY ALL),
model AS (SELECT feature, centre, sqrt(greatest((v0 * n0 + v1 * n1) / (n0 + n1 - 2), 1e-12)) AS scale, m0, m1, n0, n1 FROM st),
md AS (SELECT feature, centre, scale, round((m0 - centre) / scale, 12) AS c0, round((m1 - centre) / scale, 12) AS c1, n0, n1 FROM model)"""


@query("dlda_fit", f"WITH {_LONG} SELECT CAST(feature AS INT) AS feature, round(centre, 8) AS centre, round(scale, 8) AS scale, round(c1 - c0, 7) AS coefficient FROM md")
def dlda_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.fit_discriminant(vectors(spark, sf_dir), "label", "feature", "x")
    return m.select("feature", F.round("centre", 8).alias("centre"), F.round("scale", 8).alias("scale"), F.round("coefficient", 7).alias("coefficient"))


@query("dlda_score", f"""WITH {_LONG}, sc AS (SELECT key, count(*) AS features, sum((x - centre) / scale * (c1 - c0) - (c1 * c1 - c0 * c0) / 2) + any_value(ln(n1 / n0)) AS o FROM long JOIN md USING (feature) WHERE x IS NOT NULL GROUP BY key)
SELECT key, features, CASE WHEN features >= 60 THEN round(o, 5) END AS log_odds, CASE WHEN features >= 60 THEN o >= 0 END AS predicted FROM sc""")
def dlda_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over available features; rows with under 60 of 64 abstain."""
    long = vectors(spark, sf_dir)
    s = evaluate.score_discriminant(long, evaluate.fit_discriminant(long, "label", "feature", "x"), "key", "feature", "x", 60)
    return s.select("key", "features", F.round("log_odds", 5).alias("log_odds"), "predicted")


@query("leakage_checks", "SELECT CAST(count(*) AS BIGINT) AS leaks FROM (SELECT vec_id FROM embeddings WHERE label = 0 INTERSECT SELECT vec_id FROM embeddings WHERE label = 1)")
def leakage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",").alias("v"), "label")
    return evaluate.split_leaks(e.filter("label = 0"), e.filter("label = 1"), ["vec_id"], ["v"]).agg(F.count("*").alias("leaks"))


@query("document_split_leaks", """
WITH t AS (SELECT doc_id, source, text, doc_id % 3 = 0 AS test FROM documents WHERE text IS NOT NULL)
SELECT 'text' AS "column", count(*) AS shared FROM (SELECT text FROM t WHERE test INTERSECT SELECT text FROM t WHERE NOT test) UNION ALL SELECT 'source', count(*) FROM (SELECT source FROM t WHERE test INTERSECT SELECT source FROM t WHERE NOT test) UNION ALL SELECT 'doc_id', 0""")
def document_split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that training and test rows share, by column: texts that were copied, sources, and no ids."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", "text")
    return evaluate.shared_values(docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0"), ["text", "source", "doc_id"])


_MAPS = """
p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'not_mapped' ELSE p_brand END AS cv, CASE p_size % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'requires_human_review' ELSE 'rejected' END AS st FROM part WHERE p_partkey % 11 <> 0),
g AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 8 = 0 THEN 'Brand#99' ELSE p_brand END AS cv, CASE WHEN p_size % 3 = 0 AND p_partkey % 6 <> 0 THEN 'accepted' WHEN p_size % 3 = 1 OR p_partkey % 6 = 0 THEN 'requires_human_review' ELSE 'rejected' END AS st FROM part WHERE p_partkey % 7 <> 0),
j AS (SELECT p.k IS NOT NULL AS inp, g.k IS NOT NULL AS ing, p.cv AS pc, g.cv AS gc, p.st AS ps, g.st AS gs FROM p FULL JOIN g USING (k))"""


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size") % 3
    p = part.filter(k % 11 != 0).select(k.alias("k"), F.when(k % 9 == 0, "not_mapped").otherwise(F.col("p_brand")).alias("common_variable"), F.when(s == 0, "accepted").when(s == 1, "requires_human_review").otherwise("rejected").alias("review_status"))
    g = part.filter(k % 7 != 0).select(k.alias("k"), F.when(k % 8 == 0, "Brand#99").otherwise(F.col("p_brand")).alias("common_variable"), F.when((s == 0) & (k % 6 != 0), "accepted").when((s == 1) | (k % 6 == 0), "requires_human_review").otherwise("rejected").alias("review_status"))
    return union_of_keys(p, g, ["k"])


_QUALITY = """
gq AS (SELECT s_suppkey AS k, CAST((s_suppkey % 90) / 100.0 AS DECIMAL(10, 6)) AS s, CASE s_suppkey % 8 WHEN 0 THEN 'out_of_scope_non_human' WHEN 1 THEN 'not_declared' ELSE 'in_scope_human' END AS sc FROM supplier),
pq AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 0 THEN CAST((s_suppkey % 90) / 100.0 + (s_suppkey % 4) * 0.05 AS DECIMAL(10, 6)) END AS s, CASE WHEN s_suppkey % 6 = 0 THEN 'out_of_scope_non_human' ELSE 'in_scope_human' END AS sc FROM supplier WHERE s_suppkey % 5 <> 0),
q AS (SELECT gq.k, gq.s AS gs, gq.sc AS gsc, pq.s AS ps, pq.sc AS psc FROM gq LEFT JOIN pq USING (k))"""


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and scopes of two sides: some predictions are missing, some without a score, some 0.15 off, which doubles would get wrong."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    score = (k % 90).cast("decimal(10,6)") / 100
    gold = s.select(k.alias("k"), score.cast("decimal(10,6)").alias("overall_score"), F.when(k % 8 == 0, "out_of_scope_non_human").when(k % 8 == 1, "not_declared").otherwise("in_scope_human").alias("scope_status"))
    off = (score + (k % 4).cast("decimal(10,6)") * F.lit("0.05").cast("decimal(4,2)")).cast("decimal(10,6)")
    predicted = s.filter(k % 5 != 0).select(k.alias("k"), F.when(k % 7 != 0, off).alias("overall_score"), F.when(k % 6 == 0, "out_of_scope_non_human").otherwise("in_scope_human").alias("scope_status"))
    return union_of_keys(predicted, gold, ["k"])


@query("benchmark_metrics", f"""
WITH {_MAPS}, {_QUALITY}, f AS (SELECT coalesce(pc <> 'not_mapped' AND ps IN ('accepted', 'requires_human_review'), false) AS cand, coalesce(gc <> 'not_mapped' AND gs <> 'rejected', false) AS want, coalesce(pc = gc AND ps = gs, false) AS same,
 coalesce(pc <> 'not_mapped' AND ps = 'accepted', false) AS auto, coalesce(gc <> 'not_mapped' AND gs = 'accepted', false) AS gold, coalesce(gc <> 'not_mapped' AND gs = 'requires_human_review', false) AS review, ing FROM j),
m AS (SELECT 'candidate_precision' AS metric, count(*) FILTER (cand AND want AND same) AS hits, count(*) FILTER (cand) AS total FROM f UNION ALL SELECT 'candidate_recall', count(*) FILTER (cand AND want AND same), count(*) FILTER (want) FROM f
 UNION ALL SELECT 'candidate_f1', 2 * count(*) FILTER (cand AND want AND same), count(*) FILTER (cand) + count(*) FILTER (want) FROM f
 UNION ALL SELECT 'auto_accept_precision', count(*) FILTER (auto AND gold AND same), count(*) FILTER (auto) FROM f UNION ALL SELECT 'auto_accept_recall', count(*) FILTER (auto AND gold AND same), count(*) FILTER (gold) FROM f
 UNION ALL SELECT 'unsafe_auto_accept_rate', count(*) FILTER (auto AND NOT (gold AND same)), count(*) FILTER (auto) FROM f UNION ALL SELECT 'review_capture_rate', count(*) FILTER (review AND same), count(*) FILTER (review) FROM f
 UNION ALL SELECT 'review_status_accuracy', count(*) FILTER (ing AND same), count(*) FILTER (ing) FROM f
 UNION ALL SELECT 'quality_score_agreement_within_0.15', count(*) FILTER (coalesce(abs(ps - gs) <= 0.15, false)), count(*) FROM q WHERE gsc <> 'out_of_scope_non_human'
 UNION ALL SELECT 'scope_status_accuracy', count(*) FILTER (coalesce(psc = gsc, false)), count(*) FROM q WHERE gsc <> 'not_declared'),
z AS (SELECT *, hits / CAST(total AS DOUBLE) AS p, CAST(total AS DOUBLE) AS n, 1.959963984540054 * 1.959963984540054 AS z2 FROM m),
c AS (SELECT *, (p + z2 / (2 * n)) / (1 + z2 / n) AS mid, 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n) AS half FROM z)
SELECT metric, hits, total, round(p, 3) AS value, CASE WHEN metric <> 'candidate_f1' THEN round(greatest(0.0, mid - half), 6) END AS low, CASE WHEN metric <> 'candidate_f1' THEN round(least(1.0, mid + half), 6) END AS high FROM c""")
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten metrics with their intervals."""
    return evaluate.benchmark_metrics(mappings(spark, sf_dir), qualities(spark, sf_dir)).select("metric", "hits", "total", "value", "low", "high")


@query("benchmark_cases", f"""
WITH {_MAPS}, r AS (SELECT list_filter([CASE WHEN NOT inp THEN 'missing_prediction' END, CASE WHEN NOT ing THEN 'unexpected_prediction' END, CASE WHEN inp AND ing AND pc <> gc THEN 'common_variable_mismatch' END, CASE WHEN inp AND ing AND ps <> gs THEN 'review_status_mismatch' END,
 CASE WHEN inp AND ps = 'accepted' AND pc <> 'not_mapped' AND NOT coalesce(ing AND gs = 'accepted' AND pc = gc, false) THEN 'unsafe_auto_accept' END], lambda x: x IS NOT NULL) AS reasons FROM j)
SELECT coalesce(list_extract(reasons, 1), 'correct') AS outcome, array_to_string(reasons, ';') AS reason_codes, count(*) AS n FROM r GROUP BY ALL""")
def benchmark_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by their first reason, with all of them."""
    return evaluate.mapping_cases(mappings(spark, sf_dir)).groupBy("outcome", "reason_codes").agg(F.count("*").alias("n"))


@query("column_scale", """
WITH l AS (SELECT vec_id AS key, i - 1 AS feature, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)), s AS (SELECT feature, avg(x) AS m, stddev_samp(x) AS sd FROM l GROUP BY ALL)
SELECT CAST(feature AS INT) AS feature, round(m, 8) AS mean, round(sd, 8) AS sd FROM s""")
def column_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.column_stats(linalg.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")).select("feature", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"))


@query("gram_matrix", """
WITH v AS (SELECT vec_id, embedding FROM embeddings), l AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM v, range(1, 65) t(i))
SELECT a.vec_id AS i, b.vec_id AS j, round(sum(a.x * b.x), 7) AS value FROM l a JOIN l b ON a.i = b.i AND a.vec_id <= b.vec_id GROUP BY ALL""")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gram matrix of all samples."""
    return linalg.gram(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", digits=7)


@query("frobenius_norm", "SELECT round(sqrt(sum(CAST(x AS DOUBLE) * x)), 6) AS norm FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def frobenius_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.frobenius(linalg.to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")).select(F.round("norm", 6).alias("norm"))


@query("f_tail", f"""
WITH RECURSIVE g AS (SELECT event_type, count(*) AS n, var_samp(value) AS v FROM events GROUP BY ALL), pr AS (SELECT a.event_type || '/' || b.event_type AS pair, a.v / b.v AS f, a.n - 1 AS d1, b.n - 1 AS d2 FROM g a JOIN g b ON a.event_type < b.event_type),
src AS (SELECT pair, d2 / 2.0 AS a, d1 / 2.0 AS b, d2 / (d2 + d1 * f) AS x FROM pr), {betainc_cte('src', 'pair')}
SELECT pair, round(f, 8) AS f, round(value, 8) AS p_value FROM pr JOIN beta USING (pair)""")
def f_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance ratio tests between event types."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.var_samp("value").alias("v"))
    a, b = g.select(F.col("event_type").alias("ta"), F.col("n").alias("na"), F.col("v").alias("va")), g.select(F.col("event_type").alias("tb"), F.col("n").alias("nb"), F.col("v").alias("vb"))
    p = a.join(dimension(b, 1_000), F.col("ta") < F.col("tb"))  # a row for each event type
    f = F.col("va") / F.col("vb")
    return p.select(F.concat("ta", F.lit("/"), "tb").alias("pair"), F.round(f, 8).alias("f"), F.round(f_upper_p(f, F.col("na") - 1, F.col("nb") - 1), 8).alias("p_value"))


@query("chi2_tail", """
WITH o AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT avg(n) AS e, count(*) - 1 AS df, sum((n - (SELECT avg(n) FROM o)) * (n - (SELECT avg(n) FROM o))) / avg(n) AS x FROM o)
SELECT df, round(x, 8) AS chi2, round(exp(-x / 2) * (1 + x / 2), 9) AS p_value FROM e""")
def chi2_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenness of event types; five types, so four degrees of freedom."""
    o = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    t = o.agg(F.avg("n").alias("e"), (F.count("*") - 1).alias("df"), F.var_pop("n").alias("v"), F.count("*").alias("k")).withColumn("x", F.col("v") * F.col("k") / F.col("e"))
    return t.select("df", F.round("x", 8).alias("chi2"), F.round(chi2_upper_p(F.col("x"), F.col("df")), 9).alias("p_value"))


@query("mann_whitney")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank test of two event types over all events: exact counts for small groups, else the tie-corrected normal form."""
    e = table(spark, sf_dir, "events").filter("event_type in ('click', 'purchase')").select("value", (F.col("event_type") == "click").alias("g"))
    u = evaluate.rank_sum(e, F.col("g"), "value")
    p = mann_whitney_two_sided_p(F.col("u"), F.col("positives"), F.col("negatives"), F.col("ties"))
    return u.select("positives", "negatives", F.round(ratio(F.col("u"), F.col("positives") * F.col("negatives")), 9).alias("auroc"), p.alias("p_value"))


@query("bh_one_stratum", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, (l_extendedprice - floor(l_extendedprice / 1000) * 1000) / 1000.0 AS p_value FROM lineitem), q AS ({bh('s')})
SELECT l_orderkey, l_linenumber, round(q_value, 9) AS q_value FROM q""")
def bh_one_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q-values over one stratum of any size, without a window in a single task."""
    price = F.col("l_extendedprice")
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((price - F.floor(price / 1000) * 1000) / 1000.0).alias("p_value"))
    return adjust_global(s).select("l_orderkey", "l_linenumber", F.round("q_value", 9).alias("q_value"))

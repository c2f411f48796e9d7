"""Join, set, aggregate and ranking queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import relational as R
from ..operators.ranks import average_ranks, quantiles
from ..registry import query, table


@query("distribution_percent", """
SELECT p_type, p_size, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT p_type, CASE WHEN p_size > 40 THEN NULL ELSE p_size // 10 END AS p_size, count(*) AS n FROM part GROUP BY ALL)""")
def distribution_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_type", F.when(F.col("p_size") <= 40, F.expr("p_size div 10").cast("int")).alias("p_size"))
    return R.distribution(part, "p_type", "p_size")


@query("topk_with_other", """
WITH c AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS rk FROM c)
SELECT CASE WHEN rk <= 6 THEN p_brand ELSE 'other' END AS p_brand, CAST(sum(n) AS BIGINT) AS n, count(*) AS members FROM r GROUP BY ALL""")
def topk_with_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return R.top_with_other(items, "p_brand", 6)


@query("corpus_summary", """
WITH perdoc AS (SELECT source, lang, doc_id, n_chars FROM documents),
s AS (SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, count(*) FILTER (n_chars IS NULL OR n_chars = 0) AS blank,
  min(n_chars) AS min_chars, CAST(quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS DOUBLE) AS median_chars, max(n_chars) AS max_chars FROM perdoc),
c AS (SELECT count(*) FILTER (multi) AS multilingual_sources FROM (SELECT source, count(DISTINCT lang) > 1 AS multi FROM perdoc GROUP BY source))
SELECT * FROM s, c""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts, per-source category, and median size: partial aggregation throughout, texts are never read."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    summary = docs.agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("languages"), F.count_if(F.coalesce(F.col("n_chars"), F.lit(0)) == 0).alias("blank"),
                       F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))
    median = quantiles(docs, [], "n_chars", [0.5], "_q").agg(F.max(F.col("_q")[0]).alias("median_chars"))  # NULL without rows
    several = docs.groupBy("source").agg(F.count_distinct("lang").alias("k")).agg(F.count_if(F.col("k") > 1).alias("multilingual_sources"))
    return summary.join(median).join(several)  # one row each


@query("species_distribution", """
SELECT lang, n, total, round(n / CAST(total AS DOUBLE), 6) AS share FROM (SELECT lang, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM documents WHERE lang IS NOT NULL GROUP BY lang)""")
def species_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distribution that carries its denominator."""
    counts = table(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("lang", "n", total.alias("total"), F.round(F.col("n") / total, 6).alias("share"))


@query("left_study_quality", """
SELECT s_suppkey, n_name, s_acctbal IS NULL OR n_name IS NULL AS incomplete FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def left_study_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with a dimension whose keys are checked to be unique."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    out = R.left_unique(table(spark, sf_dir, "supplier"), R.dimension(nation), ["s_nationkey"])
    return out.select("s_suppkey", "n_name", (F.col("s_acctbal").isNull() | F.col("n_name").isNull()).alias("incomplete"))


@query("one_to_many_collect", """
SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(statuses, '') AS statuses FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, string_agg(o_orderstatus, ';' ORDER BY o_orderdate, o_orderkey) AS statuses FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) ON o_custkey = c_custkey""")
def one_to_many_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the ordered array of their urgent orders; a customer without one has an empty array."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    out = R.one_to_many(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderdate", "o_orderkey"], "urgent")
    return out.select("c_custkey", F.size("urgent").cast("bigint").alias("orders"), F.array_join("urgent.o_orderstatus", ";").alias("statuses"))


@query("lookup_unambiguous", """
WITH dim AS (SELECT p_name AS key, min(p_partkey) AS id FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, id IS NOT NULL AS resolved, coalesce(id = l_partkey, false) AS agrees FROM q LEFT JOIN dim ON key = p_name""")
def lookup_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup by name in a dimension whose ambiguous names are taken out first."""
    part = table(spark, sf_dir, "part").select("p_name", "p_partkey")
    dim = R.unambiguous_dimension(part, "p_name", "p_partkey").withColumnRenamed("p_partkey", "id")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    out = rows.join(dim, "p_name", "left")
    return out.select("l_orderkey", "l_linenumber", F.col("id").isNotNull().alias("resolved"), F.coalesce(F.col("id") == F.col("p_partkey"), F.lit(False)).alias("agrees"))


@query("lookup_first_wins", """
WITH dim AS (SELECT lower(p_name) AS key, arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY 1)
SELECT p_partkey, dim.p_type AS first_type FROM part LEFT JOIN dim ON key = lower(p_name)""")
def lookup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    dim = R.first_dimension(part.select(F.lower("p_name").alias("key"), "p_partkey", "p_type"), "key", "p_partkey").select("key", F.col("p_type").alias("first_type"))
    return part.select("p_partkey", F.lower("p_name").alias("key")).join(dim, "key", "left").select("p_partkey", "first_type")


@query("annotate_id_then_name", """
WITH parts AS (SELECT p_partkey, lower(p_name) AS name, p_type AS label FROM part),
ids AS (SELECT p_partkey, label FROM parts WHERE p_partkey % 3 = 0),
names AS (SELECT name, min(label) AS label FROM parts GROUP BY name HAVING count(DISTINCT label) = 1)
SELECT p.p_partkey, coalesce(i.label, n.label) AS label, CASE WHEN i.label IS NOT NULL THEN 'id' WHEN n.label IS NOT NULL THEN 'name' ELSE 'unresolved' END AS basis,
 i.label IS NOT NULL AND n.label IS NOT NULL AND i.label <> n.label AS conflict FROM parts p LEFT JOIN ids i USING (p_partkey) LEFT JOIN names n USING (name)""")
def annotate_id_then_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), F.col("p_type").alias("label"))
    ids = parts.filter("p_partkey % 3 = 0").select("p_partkey", "label")  # the lookup by id knows a third of the parts
    names = R.unambiguous_dimension(parts.select("name", "label"), "name", "label")
    return R.annotate(parts.select("p_partkey", "name"), ids, names, "p_partkey", "name", "label").select("p_partkey", "label", "basis", "conflict")


_CASES = """
WITH p AS (SELECT doc_id, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS quality FROM documents WHERE lang = 'en'),
g AS (SELECT doc_id, quality FROM labels),
j AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, p.doc_id IS NOT NULL AS in_p, g.doc_id IS NOT NULL AS in_g, p.quality AS pq, g.quality AS gq FROM p FULL JOIN g ON p.doc_id = g.doc_id),
c AS (SELECT *, CASE WHEN NOT in_p THEN 'missing_prediction' WHEN NOT in_g THEN 'unexpected_prediction' WHEN pq <> gq THEN 'value_mismatch' ELSE 'correct' END AS outcome FROM j)"""


def label_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("quality"))
    joined = R.union_of_keys(predicted, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])
    outcome = F.when(~F.col("in_predicted"), "missing_prediction").when(~F.col("in_gold"), "unexpected_prediction").when(F.col("p_quality") != F.col("g_quality"), "value_mismatch").otherwise("correct")
    return joined.withColumn("outcome", outcome)


@query("full_outer_reason_codes", _CASES + " SELECT outcome, count(*) AS cases FROM c GROUP BY ALL")
def full_outer_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of predicted and gold keys, each case with the first reason that applies."""
    return label_cases(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("cases"))


@query("flatten_disagreements", _CASES + " SELECT doc_id, outcome, pq AS predicted, gq AS gold FROM c WHERE outcome <> 'correct'")
def flatten_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_cases(spark, sf_dir).filter("outcome <> 'correct'").select("doc_id", "outcome", F.col("p_quality").alias("predicted"), F.col("g_quality").alias("gold"))


@query("exact_universe_gate", """
WITH d AS (SELECT doc_id, 1 AS q FROM documents), u AS (SELECT count(*) AS differing FROM d FULL JOIN labels l USING (doc_id) WHERE d.q IS NULL OR l.doc_id IS NULL OR l.quality IS NULL AND l.toxic IS NULL),
m AS (SELECT count(*) AS pairs, avg(CASE WHEN d.q = l.quality THEN 1.0 ELSE 0.0 END) AS agreement FROM d JOIN labels l USING (doc_id))
SELECT CASE WHEN differing = 0 THEN pairs END AS pairs, CASE WHEN differing = 0 THEN agreement END AS agreement, CASE WHEN differing = 0 THEN 'compared' ELSE 'blocked' END AS status FROM u, m""")
def exact_universe_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unequal key sets block the comparison: metrics are NULL, not partial."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("quality"))
    metrics = [F.count("*").alias("pairs"), F.avg((F.col("l.quality") == F.col("r.quality")).cast("double")).alias("agreement")]
    return R.exact_universe(docs, table(spark, sf_dir, "labels"), ["doc_id"], metrics)[0]


@query("universe_anti", """
SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def universe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.symmetric_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("semi_both_sides", """
SELECT count(*) AS parts FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def semi_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey")
    return part.join(items.filter("l_returnflag = 'R'"), "p_partkey", "left_semi").join(items.filter("l_returnflag = 'A'"), "p_partkey", "left_semi").agg(F.count("*").alias("parts"))


_TWO = """
WITH u AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS x, avg(value) FILTER (event_type = 'purchase') AS y FROM events GROUP BY ALL),
k AS (SELECT * FROM u WHERE x IS NOT NULL AND y IS NOT NULL)"""


def two_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of a participant side by side: conditional aggregation in place of a self-join."""
    e = table(spark, sf_dir, "events").filter("event_type in ('click', 'purchase')")
    pick = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return e.groupBy("user_id").agg(pick("click").alias("x"), pick("purchase").alias("y")).filter("x is not null and y is not null")


@query("inner_two_measures", _TWO + " SELECT user_id, round(x, 8) AS x, round(y, 8) AS y, x > y AS x_larger FROM k")
def inner_two_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_measures(spark, sf_dir).select("user_id", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"), (F.col("x") > F.col("y")).alias("x_larger"))


@query("spearman_ols", _TWO + """
, r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM k)
SELECT count(*) AS n, round(corr(x, y), 9) AS pearson_r, round(corr(rx, ry), 9) AS spearman_rho, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM r""")
def spearman_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson, Spearman (average ranks) and least squares over participants."""
    k = two_measures(spark, sf_dir)
    r = average_ranks(average_ranks(k, "x", "rx"), "y", "ry")
    return r.agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 9).alias("pearson_r"), F.round(F.corr("rx", "ry"), 9).alias("spearman_rho"), F.round(F.regr_slope("y", "x"), 9).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


@query("pairs_theta", """
SELECT DISTINCT a.p_partkey AS left_key, b.p_partkey AS right_key FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def pairs_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered candidate pairs by a shared identity, never all pairs."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type", "p_size").alias("identity"))
    return R.pairs_by_shared(part, "p_partkey", "identity")


@query("lane_overlap_score", """
WITH s AS (SELECT source, list(DISTINCT lang) AS lanes, count(*) AS n FROM documents GROUP BY source),
k AS (SELECT source, len(list_intersect(lanes, ['en', 'de'])) AS lane_hits, n FROM s)
SELECT source, CAST(lane_hits AS BIGINT) AS lane_hits, CAST(20 * lane_hits + least(n, 40) AS BIGINT) AS score, row_number() OVER (ORDER BY 20 * lane_hits + least(n, 40) DESC, source) AS routing_rank FROM k WHERE lane_hits > 0""")
def lane_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by overlap of their lanes with the wanted ones."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("lanes"), F.count("*").alias("n"))
    hits = F.size(F.array_intersect("lanes", F.array(F.lit("en"), F.lit("de")))).cast("bigint")
    scored = s.select("source", hits.alias("lane_hits"), (20 * hits + F.least(F.col("n"), F.lit(40))).alias("score")).filter("lane_hits > 0")
    return R.ranked(scored, [], [F.desc("score"), "source"], "routing_rank")


@query("intersect_keys", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'es'")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter("lang = 'en'").select("source").intersect(docs.filter("lang = 'es'").select("source"))


@query("except_keys", "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey").subtract(orders.filter("o_orderpriority = '5-LOW'").select("o_custkey"))


@query("presence_matrix", """
SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS INT) AS in_open, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS INT) AS in_filled, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS INT) AS in_partial FROM (SELECT DISTINCT c_custkey FROM customer)""")
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return R.presence(table(spark, sf_dir, "customer"), "c_custkey", {"open": o.filter("o_orderstatus = 'O'"), "filled": o.filter("o_orderstatus = 'F'"), "partial": o.filter("o_orderstatus = 'P'")})


@query("union_sources", """
SELECT 'documents' AS origin, count(*) AS rows, count(lang) AS with_lang FROM documents UNION ALL SELECT 'benchmark', count(*), 0 FROM benchmark UNION ALL SELECT 'conversations', count(*), 0 FROM conversations""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union by name of sources with differing columns; a missing column is NULL."""
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "lang")
    rest = [table(spark, sf_dir, t).select(F.lit(t).alias("origin")) for t in ("benchmark", "conversations")]
    out = docs
    for r in rest:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.groupBy("origin").agg(F.count("*").alias("rows"), F.count("lang").alias("with_lang"))


@query("dedup_pair_first", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL")
def dedup_pair_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs, the first occurrence by order wins."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first_order"))


@query("first_by_key_blank_kept", """
WITH k AS (SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE source END AS key FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM k)
SELECT doc_id, key FROM r WHERE rn = 1 OR key = ''""")
def first_by_key_blank_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "es", "").otherwise(F.col("source")).alias("key"))
    return R.first_by_key(docs, ["key"], ["doc_id"])


@query("last_row_wins", "SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS last_status, max(o_orderkey) AS last_order FROM orders GROUP BY ALL")
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return R.last_by_key(o, ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("last_status"), F.col("o_orderkey").alias("last_order"))


@query("most_common_first_seen", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS rn FROM c)
SELECT user_id, event_type AS most_common FROM r WHERE rn = 1""")
def most_common_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    return c.groupBy("user_id").agg(R.most_common("event_type", "seen").alias("most_common"))


@query("distinct_join", """
SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '; ' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY ALL""")
def distinct_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.collections import joined_set

    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(joined_set(F.col("o_orderstatus")).alias("statuses"))


@query("counts_by_columns", """
WITH d AS (SELECT lang, source, CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS size, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS field, lang AS value, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'size', size, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM d GROUP BY 2""")
def counts_by_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of five columns in one scan and one shuffle."""
    n = F.col("n_chars")
    size = F.when(n.isNull(), "unknown").when(n < 500, "short").when(n < 5000, "middle").otherwise("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", size.alias("size")).join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return R.value_counts(docs, ["lang", "source", "size", "quality", "toxic"])


@query("namespace_counts", """
WITH a AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'chebi' WHEN 1 THEN 'kegg_compound' WHEN 2 THEN 'hmdb' ELSE 'unrecognised' END AS namespace FROM part) SELECT 'namespace' AS field, namespace AS value, count(*) AS n FROM a GROUP BY 2""")
def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers by the namespace that their grammar tells; what fits none is counted too."""
    from ..functions.text import namespace

    k = F.col("p_partkey")
    identifier = F.when(k % 4 == 0, F.concat(F.lit("CHEBI:"), k + 1)).when(k % 4 == 1, F.concat(F.lit("C"), F.lpad((k % 99999).cast("string"), 5, "0"))).when(k % 4 == 2, F.concat(F.lit("HMDB"), F.lpad(k.cast("string"), 7, "0"))).otherwise(F.lit("?"))
    return R.value_counts(table(spark, sf_dir, "part").select(F.coalesce(namespace(identifier), F.lit("unrecognised")).alias("namespace")), ["namespace"])


@query("ambiguous_keys", """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, count(*) FILTER (n > 1) AS ambiguous_keys FROM c GROUP BY ALL""")
def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.paired import ambiguous_count

    return ambiguous_count(table(spark, sf_dir, "part"), ["p_brand"], "p_type")


@query("stratum_value", """
SELECT concat_ws(' | ', 'flag=' || l_returnflag, 'status=' || l_linestatus, 'note=not_reported') AS stratum, count(*) AS n FROM lineitem GROUP BY ALL""")
def stratum_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("not_reported")))
    stratum = F.concat_ws(" | ", part("flag", F.col("l_returnflag")), part("status", F.col("l_linestatus")), part("note", F.lit("")))
    return table(spark, sf_dir, "lineitem").groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"))


@query("wilson_metrics", """
WITH m AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
w AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.959963984540054 AS z FROM m)
SELECT lang, n, k, round(p, 6) AS share, round(greatest(0.0, ((p + z * z / (2 * n)) / (1 + z * z / n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * CAST(n AS DOUBLE) * n)) / (1 + z * z / n)), 6) AS low,
 round(least(1.0, ((p + z * z / (2 * n)) / (1 + z * z / n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * CAST(n AS DOUBLE) * n)) / (1 + z * z / n)), 6) AS high FROM w""")
def wilson_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return m.select("lang", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("share"), low.alias("low"), high.alias("high"))

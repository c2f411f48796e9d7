"""Queries over digests, bundles and versioned snapshots; the repository's indexes are built from the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..registry import query, table
from ..sources import snapshots
from ..staging import discard, shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/veridex/{name}-{uuid.uuid4().hex}"
    discard(spark, path)
    return path


_ROW = "'doc_id:' || coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || ';lang:' || coalesce(length(lang) || ':' || lang, '-') || ';n_chars:' || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || ';source:' || coalesce(length(source) || ':' || source, '-') || ';text:' || coalesce(length(text) || ':' || text, '-') || ';'"
_SUMS = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS HUGEINT) AS d{i}" for i in range(4))


@query("table_digests", f"""
WITH r AS (SELECT source, sha256({_ROW}) AS h FROM documents), g AS (SELECT source, count(*) AS n, {_SUMS} FROM r GROUP BY source),
a AS (SELECT * FROM g UNION ALL SELECT 'all sources', sum(n), sum(d0), sum(d1), sum(d2), sum(d3) FROM g)
SELECT source, CAST(n AS BIGINT) AS n, sha256(concat_ws('|', CAST(n AS BIGINT), d0, d1, d2, d3)) AS sha256 FROM a""")
def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digests of the documents of each source, and merged from these the digest of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    by = snapshots.multiset_digest(docs, ["source"])
    return by.unionByName(snapshots.merged(by).withColumn("source", F.lit("all sources"))).select("source", "n", snapshots.sealed().alias("sha256"))


@query("bundle_checks", """
WITH n AS (SELECT count(*) AS s, count(DISTINCT s_suppkey) AS sk, count(*) FILTER (s_suppkey IS NULL) AS sb FROM supplier),
l AS (SELECT count(*) AS n, count(DISTINCT l_orderkey) AS k, count(*) FILTER (c > 1) AS again FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) JOIN lineitem USING (l_orderkey)), o AS (SELECT count(*) AS again FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)),
u AS (SELECT count(*) AS lonely FROM (SELECT s_nationkey FROM (SELECT DISTINCT s_nationkey, 'a' AS t FROM supplier UNION ALL SELECT DISTINCT n_nationkey, 'b' FROM nation) GROUP BY 1 HAVING count(*) < 2))
SELECT 'sound' AS bundle, * FROM (SELECT NULL AS "table", 'commit' AS "check", true AS ok, '' AS detail UNION ALL SELECT t, c, true, '' FROM (SELECT unnest(['nation', 'supplier']) AS t), (SELECT unnest(['path', 'columns', 'digest']) AS c)
  UNION ALL SELECT 'supplier', 'row_count', true, CAST(s AS VARCHAR) FROM n UNION ALL SELECT 'nation', 'row_count', true, CAST(count(*) AS VARCHAR) FROM nation
  UNION ALL SELECT 'supplier', 'blank_key', sb = 0, CAST(sb AS VARCHAR) FROM n UNION ALL SELECT 'supplier', 'repeated_key', s = sk, CAST(s - sk AS VARCHAR) FROM n
  UNION ALL SELECT 'nation', 'blank_key', true, '0' UNION ALL SELECT 'nation', 'repeated_key', true, '0' UNION ALL SELECT NULL, 'universe', lonely = 0, CAST(lonely AS VARCHAR) FROM u)
UNION ALL SELECT 'broken', * FROM (SELECT NULL, 'commit', true, '' UNION ALL SELECT 'away', 'path', false, '../sound/supplier leaves the bundle' UNION ALL SELECT 'lost', 'path', false, 'no such table'
  UNION ALL SELECT 'lines', c, true, '' FROM (SELECT unnest(['path', 'columns', 'digest']) AS c) UNION ALL SELECT 'lines', 'row_count', true, CAST(n AS VARCHAR) FROM l UNION ALL SELECT 'lines', 'blank_key', true, '0' UNION ALL SELECT 'lines', 'repeated_key', o.again = 0, CAST(o.again AS VARCHAR) FROM o
  UNION ALL SELECT 'changed', c, true, '' FROM (SELECT unnest(['path', 'columns']) AS c) UNION ALL SELECT 'changed', 'digest', false, '' UNION ALL SELECT 'changed', 'row_count', false, CAST(2 * count(*) AS VARCHAR) FROM region
  UNION ALL SELECT 'changed', 'blank_key', true, '0' UNION ALL SELECT 'changed', 'repeated_key', false, CAST(count(*) AS VARCHAR) FROM region)
UNION ALL SELECT 'half', NULL, 'commit', false, 'not committed' UNION ALL SELECT 'forged', NULL, 'commit', false, 'the manifest is not the one that was committed'""")
def bundle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of a sound bundle, of a broken one, of a half-written one and of one whose manifest was replaced."""
    root = _folder(spark, "bundles")
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    snapshots.commit(spark, root, "sound", {"supplier": t("supplier"), "nation": nation}, {"supplier": ["s_suppkey"], "nation": ["s_nationkey"]}, "s_nationkey")
    made = snapshots.commit(spark, root, "broken", {"lines": t("lineitem").select("l_orderkey", "l_linenumber"), "changed": t("region")}, {"lines": ["l_orderkey"], "changed": ["r_regionkey"]})
    t("region").write.mode("append").parquet(f"{root}/broken/changed")  # after the commit
    made["files"]["away"] = {**made["files"]["lines"], "path": "../sound/supplier"}
    made["files"]["lost"] = {**made["files"]["lines"], "path": "lost"}
    text = snapshots.canonical_json(made)
    snapshots._put(spark, f"{root}/broken/{snapshots.MANIFEST}", text)
    snapshots._put(spark, f"{root}/broken/{snapshots.MARKER}", snapshots.hashlib.sha256(text.encode()).hexdigest())
    t("region").write.parquet(f"{root}/half/region")
    snapshots._put(spark, f"{root}/half/{snapshots.MANIFEST}", json.dumps({"files": {}}))
    snapshots.commit(spark, root, "forged", {"region": t("region")}, {})
    snapshots._put(spark, f"{root}/forged/{snapshots.MANIFEST}", json.dumps({"files": {}}))
    out = snapshots.check(spark, root, "sound")
    for version in ("broken", "half", "forged"):
        out = out.unionByName(snapshots.check(spark, root, version))
    return out


#: The repository's bulk indexes, with repeated and blank rows; ``odd`` rows come a second time.
_INDEXES = """
su AS (SELECT 'ST' || s_suppkey AS study_id, s_name AS study_title, s_suppkey AS position FROM supplier UNION ALL SELECT 'ST' || s_suppkey, 'again ' || s_name, 1000000 + s_suppkey FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT '', 'blank', 2000000 + r_regionkey FROM region),
an AS (SELECT 'AN' || p_partkey AS analysis_id, 'ST' || (p_partkey % 130) AS study_id, CASE p_partkey % 4 WHEN 0 THEN 'Targeted ' || p_type WHEN 1 THEN 'non-targeted ' || p_type ELSE p_type END AS analysis_summary, p_name AS analysis_display, 'MS' AS analysis_type, p_partkey AS position FROM part
  UNION ALL SELECT 'AN' || p_partkey, 'ST0', 'untargeted', p_name, 'MS', 1000000 + p_partkey FROM part WHERE p_partkey % 11 = 0),
co AS (SELECT 'AN' || l_partkey AS analysis_id, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE CAST(count(*) AS VARCHAR) END AS num_metabolites, l_partkey AS position FROM lineitem GROUP BY l_partkey UNION ALL SELECT 'AN' || p_partkey, '5', 1000000 + p_partkey FROM part WHERE p_partkey % 13 = 0),
un AS (SELECT 'AN' || p_partkey AS analysis_id, 'ST' || (p_partkey % 130) AS study_id, p_partkey AS position FROM part WHERE p_size % 5 = 0 UNION ALL SELECT 'AN' || p_partkey, 'ST0', 1000000 + p_partkey FROM part WHERE p_size % 10 = 0),
sp AS (SELECT 'ST' || (c_custkey % 110) AS study_id, CASE WHEN c_nationkey = 3 THEN '' ELSE n_name END AS latin_name, c_mktsegment AS common_name, c_custkey AS position FROM customer JOIN nation ON n_nationkey = c_nationkey),
dsu AS (SELECT * FROM su QUALIFY study_id = '' OR row_number() OVER (PARTITION BY study_id ORDER BY position) = 1),
dan AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY position) = 1), dco AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY position) = 1),
dun AS (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY position) = 1), dsp AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY study_id, latin_name ORDER BY position) = 1),
tx AS (SELECT dan.*, dun.analysis_id IS NOT NULL AS indexed, lower(concat_ws(' ', analysis_summary, analysis_display, analysis_type)) AS words FROM dan LEFT JOIN dun USING (analysis_id)),
ca AS (SELECT *, CASE WHEN indexed OR regexp_matches(words, '\\b(untargeted|un-targeted|non-targeted)\\b') THEN 'explicit_untargeted' WHEN regexp_matches(words, '\\btargeted\\b') THEN 'explicit_targeted' ELSE 'unclassified_or_other' END AS assay_scope FROM tx),
st AS (SELECT study_id, bool_or(assay_scope = 'explicit_targeted') AS t, bool_or(assay_scope = 'explicit_untargeted') AS u, count(*) AS n FROM ca GROUP BY 1),
sc AS (SELECT s.study_id, coalesce(t, false) AS has_explicit_targeted_analysis, coalesce(u, false) AS has_explicit_untargeted_analysis, CASE WHEN t AND u THEN 'both_explicit' WHEN t THEN 'targeted_explicit_only' WHEN u THEN 'untargeted_explicit_only' ELSE 'neither_explicit_or_no_analysis' END AS study_assay_category, coalesce(n, 0) AS analysis_count FROM (SELECT DISTINCT study_id FROM dsu WHERE study_id <> '') s LEFT JOIN st USING (study_id)),
ps AS (SELECT study_id, count(DISTINCT CASE latin_name WHEN '' THEN 'unknown' ELSE latin_name END) AS k FROM dsp GROUP BY 1),
sd AS (SELECT CASE latin_name WHEN '' THEN 'unknown' ELSE latin_name END AS latin_name, array_to_string(list_sort(list(DISTINCT common_name)), '; ') AS common_names, count(DISTINCT study_id) AS study_count FROM dsp GROUP BY 1),
sr AS (SELECT latin_name, common_names, study_count, round(100.0 * study_count / (SELECT count(DISTINCT study_id) FROM dsp), 4) AS percent_of_species_annotated_studies FROM sd)"""


def indexes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same in Spark, by the names of the tables that they become."""
    t = lambda name: table(spark, sf_dir, name)
    st = lambda c: F.concat(F.lit("ST"), c)
    an = lambda c: F.concat(F.lit("AN"), F.col(c))
    later = lambda c: F.col(c) + 1_000_000
    s, p = t("supplier"), t("part")
    su = s.select(st(F.col("s_suppkey")).alias("study_id"), F.col("s_name").alias("study_title"), F.col("s_suppkey").alias("position"))
    su = su.unionByName(s.filter("s_suppkey % 7 = 0").select(st(F.col("s_suppkey")).alias("study_id"), F.concat(F.lit("again "), "s_name").alias("study_title"), later("s_suppkey").alias("position"))).unionByName(t("region").select(F.lit("").alias("study_id"), F.lit("blank").alias("study_title"), (F.col("r_regionkey") + 2_000_000).cast("bigint").alias("position")))
    k = F.col("p_partkey")
    label = F.when(k % 4 == 0, F.concat(F.lit("Targeted "), "p_type")).when(k % 4 == 1, F.concat(F.lit("non-targeted "), "p_type")).otherwise(F.col("p_type"))
    a = p.select(an("p_partkey").alias("analysis_id"), st(k % 130).alias("study_id"), label.alias("analysis_summary"), F.col("p_name").alias("analysis_display"), F.lit("MS").alias("analysis_type"), k.alias("position"))
    a = a.unionByName(p.filter("p_partkey % 11 = 0").select(an("p_partkey").alias("analysis_id"), F.lit("ST0").alias("study_id"), F.lit("untargeted").alias("analysis_summary"), F.col("p_name").alias("analysis_display"), F.lit("MS").alias("analysis_type"), later("p_partkey").alias("position")))
    c = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).select(an("l_partkey").alias("analysis_id"), F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.col("n").cast("string")).alias("num_metabolites"), F.col("l_partkey").alias("position"))
    c = c.unionByName(p.filter("p_partkey % 13 = 0").select(an("p_partkey").alias("analysis_id"), F.lit("5").alias("num_metabolites"), later("p_partkey").alias("position")))
    u = p.filter("p_size % 5 = 0").select(an("p_partkey").alias("analysis_id"), st(k % 130).alias("study_id"), k.alias("position")).unionByName(p.filter("p_size % 10 = 0").select(an("p_partkey").alias("analysis_id"), F.lit("ST0").alias("study_id"), later("p_partkey").alias("position")))
    sp = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(st(F.col("c_custkey") % 110).alias("study_id"), F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("n_name")).alias("latin_name"), F.col("c_mktsegment").alias("common_name"), F.col("c_custkey").alias("position"))
    return {"study_summaries": su, "analyses": a, "analysis_metabolite_counts": c, "untargeted_analyses": u, "study_species": sp}


def _tables(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return corpus.corpus_tables(found["study_summaries"], found["analyses"], found["analysis_metabolite_counts"], found["untargeted_analyses"], found["study_species"])


@query("corpus_study_scopes", "WITH " + _INDEXES + " SELECT * FROM sc")
def corpus_study_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assay category of each study of the snapshot."""
    return _tables(indexes(spark, sf_dir))["study_assay_scope"]


@query("corpus_species", "WITH " + _INDEXES + " SELECT * FROM sr")
def corpus_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species with their share of the studies that have one."""
    return _tables(indexes(spark, sf_dir))["species_distribution"]


@query("corpus_metrics", "WITH " + _INDEXES + """, m AS (
 SELECT unnest([
  {'metric': 'study_count', 'value': (SELECT count(*) FROM dsu)::DOUBLE}, {'metric': 'study_summary_duplicate_rows_removed', 'value': (SELECT count(*) FROM su) - (SELECT count(*) FROM dsu)},
  {'metric': 'analysis_count', 'value': (SELECT count(*) FROM dan)}, {'metric': 'analysis_duplicate_rows_removed', 'value': (SELECT count(*) FROM an) - (SELECT count(*) FROM dan)},
  {'metric': 'explicit_untargeted_index_analysis_count', 'value': (SELECT count(*) FROM dun)}, {'metric': 'untargeted_duplicate_rows_removed', 'value': (SELECT count(*) FROM un) - (SELECT count(*) FROM dun)},
  {'metric': 'analysis_metabolite_count_rows', 'value': (SELECT count(*) FROM dco)}, {'metric': 'analysis_metabolite_count_duplicate_rows_removed', 'value': (SELECT count(*) FROM co) - (SELECT count(*) FROM dco)},
  {'metric': 'species_unique_study_latin_name_pair_count', 'value': (SELECT count(*) FROM dsp)}, {'metric': 'species_duplicate_pair_rows_removed', 'value': (SELECT count(*) FROM sp) - (SELECT count(*) FROM dsp)},
  {'metric': 'species_annotated_study_count', 'value': (SELECT count(*) FROM ps)}, {'metric': 'single_species_study_count', 'value': (SELECT count(*) FROM ps WHERE k = 1)}, {'metric': 'multi_species_study_count', 'value': (SELECT count(*) FROM ps WHERE k > 1)},
  {'metric': 'distinct_latin_name_count', 'value': (SELECT count(*) FROM sd)}, {'metric': 'species_missing_study_count', 'value': (SELECT count(*) FROM sc ANTI JOIN ps USING (study_id))}, {'metric': 'species_index_only_study_count', 'value': (SELECT count(*) FROM ps ANTI JOIN sc USING (study_id))},
  {'metric': 'analysis_scope_counts.explicit_targeted', 'value': (SELECT count(*) FROM ca WHERE assay_scope = 'explicit_targeted')}, {'metric': 'analysis_scope_counts.explicit_untargeted', 'value': (SELECT count(*) FROM ca WHERE assay_scope = 'explicit_untargeted')}, {'metric': 'analysis_scope_counts.unclassified_or_other', 'value': (SELECT count(*) FROM ca WHERE assay_scope = 'unclassified_or_other')},
  {'metric': 'study_assay_category_counts.both_explicit', 'value': (SELECT count(*) FROM sc WHERE study_assay_category = 'both_explicit')}, {'metric': 'study_assay_category_counts.targeted_explicit_only', 'value': (SELECT count(*) FROM sc WHERE study_assay_category = 'targeted_explicit_only')},
  {'metric': 'study_assay_category_counts.untargeted_explicit_only', 'value': (SELECT count(*) FROM sc WHERE study_assay_category = 'untargeted_explicit_only')}, {'metric': 'study_assay_category_counts.neither_explicit_or_no_analysis', 'value': (SELECT count(*) FROM sc WHERE study_assay_category = 'neither_explicit_or_no_analysis')},
  {'metric': 'analysis_metabolite_numeric_count_rows', 'value': (SELECT count(*) FROM dco WHERE num_metabolites <> '')}, {'metric': 'analysis_metabolite_blank_count_rows', 'value': (SELECT count(*) FROM dco WHERE num_metabolites = '')},
  {'metric': 'analysis_feature_row_sum', 'value': (SELECT coalesce(sum(TRY_CAST(num_metabolites AS BIGINT)), 0) FROM dco)}, {'metric': 'analysis_feature_count_minimum', 'value': (SELECT min(TRY_CAST(num_metabolites AS BIGINT)) FROM dco)}, {'metric': 'analysis_feature_count_maximum', 'value': (SELECT max(TRY_CAST(num_metabolites AS BIGINT)) FROM dco)},
  {'metric': 'analysis_feature_count_median', 'value': (SELECT quantile_cont(TRY_CAST(num_metabolites AS BIGINT), 0.5) FROM dco)}, {'metric': 'analyses_without_metabolite_count_record', 'value': (SELECT count(*) FROM dan) - (SELECT count(*) FROM dco)}]) AS x)
SELECT x.metric AS metric, x.value AS value FROM m""")
def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of a snapshot, the rows that were removed among them."""
    raw = indexes(spark, sf_dir)
    return corpus.corpus_metrics(_tables(raw), raw)


KEYS = {"study_summaries": ["study_id"], "study_species": ["study_id", "latin_name"], "analyses": ["analysis_id"], "analysis_metabolite_counts": ["analysis_id"], "untargeted_analyses": ["analysis_id"], "species_distribution": ["latin_name"], "study_assay_scope": ["study_id"]}


@query("corpus_snapshot_diff", "WITH " + _INDEXES + """
SELECT 'analyses' AS "table", analysis_id AS key, CASE WHEN position % 17 = 0 THEN 'gone' WHEN position % 19 = 0 THEN 'changed' END AS state FROM dan WHERE position % 17 = 0 OR position % 19 = 0 UNION ALL SELECT 'analyses', 'NEW' || analysis_id, 'added' FROM dan WHERE position % 23 = 0
UNION ALL SELECT 'untargeted_analyses', analysis_id, 'gone' FROM dun WHERE position % 17 = 0""")
def corpus_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a snapshot, each published whole and read back through its checks: what was added, is gone or changed."""
    root = _folder(spark, "corpus")
    raw = indexes(spark, sf_dir)
    raw["study_summaries"] = raw["study_summaries"].filter("study_id <> ''")  # keys of a bundle aren't blank
    first = _tables(raw)
    first["study_species"] = first["study_species"].withColumn("latin_name", F.when(F.col("latin_name") == "", "unknown").otherwise(F.col("latin_name")))
    snapshots.commit(spark, root, "v1", first, KEYS)
    old = snapshots.read_version(spark, root, "v1")
    analyses, k = old["analyses"], F.col("position")
    second = dict(old)
    second["analyses"] = analyses.filter(k % 17 != 0).withColumn("analysis_display", F.when(k % 19 == 0, F.concat("analysis_display", F.lit(" revised"))).otherwise(F.col("analysis_display"))).unionByName(analyses.filter(k % 23 == 0).withColumn("analysis_id", F.concat(F.lit("NEW"), "analysis_id")))
    second["untargeted_analyses"] = old["untargeted_analyses"].filter(k % 17 != 0)
    snapshots.commit(spark, root, "v2", second, KEYS)
    new = snapshots.read_version(spark, root, "v2")
    out = None
    for name, keys in KEYS.items():
        part = snapshots.difference(old[name], new[name], keys).select(F.lit(name).alias("table"), F.concat_ws("/", *keys).alias("key"), "state")
        out = part if out is None else out.unionByName(part)
    return out

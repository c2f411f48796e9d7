"""Typed loads, aliases, echoes and refusals as queries: text rows are written out of the given tables and read as entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as X
from ..operators import constraints, intake, ledger, screening
from ..registry import query, table
from ..schemas import MODALITY_FLAGS
from ..sources.files import agreeing


def _pick(values: list[str | None], k: Column) -> Column:
    """The value of a list that a number leads to."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))


def _picked(values: list[str | None], k: str) -> str:
    return "list_extract([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"], CAST({k} % {len(values)} + 1 AS INT))"


FLAGS = ["true", "FALSE", " yes ", "Y", "1", "0", "", None, "unknown"]
BLANKS = ["x", " ", "", None, " kept "]
STATES = ["open", " Public", "controlled", "", None, "not_available", "closed", "unknown", "Available"]
SIZES = ["12", "12.0", "n/a", "", "7.9", None, "inf", "-3"]

_FLAG = "coalesce(lower(trim({})) IN ('1', 'true', 'yes', 'y'), false)"
_FILLED = "coalesce(nullif(trim({}), ''), '{}')"


@query("typed_publications", "WITH r AS (SELECT p_partkey AS k, " + ", ".join(f"{_picked(FLAGS, f'(p_partkey + {i})')} AS {f}" for i, f in enumerate(("human", *MODALITY_FLAGS))) + f", {_picked(BLANKS, 'p_partkey')} AS doi, {_picked(BLANKS, '(p_partkey // 5)')} AS title FROM part) SELECT 'S' || k AS study_id, {_FILLED.format('title', '')} AS title, {_FILLED.format('doi', 'not_reported')} AS doi, 'not_reported' AS pmid, " + ", ".join(f"{_FLAG.format(f)} AS {f}" for f in ("human", *MODALITY_FLAGS)) + ", 'not_available' AS repository_accession, '' AS notes FROM r")
def typed_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as publications: lenient flags, defaults for what isn't filled."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("S"), k).alias("study_id"), *[_pick(FLAGS, k + i).alias(f) for i, f in enumerate(("human", *MODALITY_FLAGS))], _pick(BLANKS, k).alias("doi"), _pick(BLANKS, F.expr("p_partkey div 5")).alias("title"))
    return intake.publications(rows)


@query("typed_repositories", f"""
WITH r AS (SELECT s_suppkey AS k, {_picked(STATES, 's_suppkey')} AS state, {_picked(FLAGS, 's_suppkey')} AS flag, {_picked(SIZES, 's_suppkey')} AS size, {_picked(BLANKS, 's_suppkey')} AS platform FROM supplier)
SELECT 'S' || k AS study_id, CASE lower(trim(coalesce(state, ''))) WHEN 'open' THEN 'public' WHEN 'available' THEN 'public' WHEN 'controlled' THEN 'restricted_metadata_only' WHEN 'closed' THEN 'not_available' WHEN '' THEN 'unknown' ELSE lower(trim(state)) END AS public_status,
 {_FLAG.format('flag')} AS has_metadata, {_FILLED.format('platform', 'unknown')} AS assay_platform, CASE size WHEN '12' THEN 12 WHEN '12.0' THEN 12 WHEN '7.9' THEN 7 WHEN '-3' THEN -3 END AS sample_size, 'a,b' AS modalities FROM r""")
def typed_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows as repository records: availability by its aliases, sizes that are no numbers as NULL, lists without blanks."""
    k = F.col("s_suppkey")
    flag = _pick(FLAGS, k)
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), k).alias("study_id"), F.lit("R").alias("repository"), F.lit("A").alias("accession"), _pick(STATES, k).alias("public_status"), flag.alias("has_metadata"), flag.alias("has_codebook"), flag.alias("has_data_files"), _pick(BLANKS, k).alias("assay_platform"), F.lit(None).cast("string").alias("sample_matrix"), F.lit("").alias("biospecimen_timing"), _pick(SIZES, k).alias("sample_size"), F.lit(" a ;; b;").alias("modalities"))
    out = intake.repositories(rows)
    return out.select("study_id", "public_status", "has_metadata", "assay_platform", "sample_size", F.array_join("modalities", ",").alias("modalities"))


@query("typed_mappings", """
SELECT 'S' || (o_orderkey % 50) AS source_study, 'v' || o_orderkey AS source_variable, CASE WHEN o_orderkey % 7 = 0 THEN 'not_mapped' ELSE 'c' || o_orderkey % 9 END AS common_variable, CASE WHEN o_orderkey % 7 = 0 THEN 'rejected' WHEN o_orderkey % 2 = 0 THEN 'accepted' ELSE 'requires_human_review' END AS review_status FROM orders""")
def typed_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings under either of two names of a column; the checks of status, unmapped rows and entities all run."""
    k = F.col("o_orderkey")
    value = F.when(k % 7 == 0, "not_mapped").otherwise(F.concat(F.lit("c"), k % 9))
    rows = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("S"), k % 50)).alias("source_study"), F.when(k % 3 < 2, F.concat(F.lit(" S"), k % 50)).alias("study_id"), F.concat(F.lit("v"), k).alias("source_variable"),
        F.when(k % 2 == 0, value).alias("common_variable"), F.when(k % 2 == 1, value).alias("proposed_common_variable"), F.when(k % 7 == 0, "rejected").when(k % 2 == 0, "accepted").otherwise("requires_human_review").alias("review_status"))
    return intake.mappings(rows)


@query("typed_quality_scores", """
SELECT 'S' || c_custkey AS study_id, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 100 / 100.0 AS DECIMAL(10, 6)) END AS overall_score, CASE WHEN c_custkey % 5 = 0 THEN 'out_of_scope_non_human' END AS scope_status FROM customer""")
def typed_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scores; a missing one needs its status."""
    k = F.col("c_custkey")
    score = F.when(k % 5 == 0, "not scored").otherwise((k % 100 / 100.0).cast("string"))
    return intake.quality_scores(table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), k).alias("study_id"), score.alias("overall_score"), F.when(k % 5 == 0, " out_of_scope_non_human").otherwise("").alias("scope_status")))


@query("typed_model_rows", """
SELECT 'm' || s_suppkey AS sample_id, 'c' || s_nationkey AS cohort_id, CASE WHEN s_suppkey % 2 = 0 THEN 'exposed' ELSE 'not_exposed' END AS label, CASE WHEN s_suppkey % 9 > 0 THEN s_acctbal END AS balance FROM supplier""")
def typed_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows of a classifier: a declared feature that is no number is NULL, undeclared columns go."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), k).alias("sample_id"), F.concat(F.lit("c"), F.col("s_nationkey")).alias("cohort_id"), F.when(k % 2 == 0, "exposed").otherwise("not_exposed").alias("label"), F.when(k % 9 == 0, "below").otherwise(F.col("s_acctbal").cast("string")).alias("balance"), F.lit("1").alias("undeclared"))
    return intake.model_rows(rows, ["balance"], "label", ("exposed", "not_exposed"), complete=False)


@query("load_refusals", """
SELECT 'repeated lines' AS rule, count(*) AS violations FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'repeated orders', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'status outside', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'negative balance', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'orders without a customer', count(*) FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'aliases that differ', count(*) FROM part WHERE p_partkey % 6 = 5""")
def load_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule refuses, as counts of violations instead of exceptions."""
    t = lambda n: table(spark, sf_dir, n)
    k = F.col("p_partkey")
    two = t("part").select(F.when(k % 3 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(k % 6 == 5, F.concat("p_name", F.lit("!"))).when(k % 2 == 0, F.col("p_name")).alias("label"))
    found = {
        "repeated lines": constraints.duplicates(t("lineitem"), "l_orderkey", "l_linenumber"), "repeated orders": constraints.duplicates(t("lineitem"), "l_orderkey"), "status outside": constraints.outside(t("orders"), "o_orderstatus", ("F", "O")),
        "negative balance": constraints.failing(t("customer"), F.col("c_acctbal") >= 0), "orders without a customer": constraints.missing_from(t("orders").select(F.col("o_custkey").alias("c_custkey")), t("customer"), "c_custkey"), "aliases that differ": agreeing(two, "name", "label")[1],
    }
    out = None
    for rule, violations in found.items():
        row = violations.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


@query("alias_registry", """
WITH n AS (SELECT p_partkey, 'f' || (p_partkey % 10) AS name FROM part), a(alias, target, current, removed_in) AS (VALUES ('f1', 'g1', [1, 10, 0], [1, 9, 0]), ('f2', 'g2', [1, 2, 3], [2, 0, 0]), ('f3', 'g3', [2, 0, 0], [2, 0, 0]))
SELECT name, coalesce(target, name) AS resolved, target IS NOT NULL AS deprecated, coalesce(current >= removed_in, false) AS removed, count(*) AS n FROM n LEFT JOIN a ON alias = name GROUP BY ALL""")
def alias_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with what replaces them; versions are compared by number and not as text."""
    aliases = spark.createDataFrame([("f1", "g1", "1.10.0", "1.9.0"), ("f2", "g2", "1.2.3", "2.0.0"), ("f3", "g3", "2.0.0", "2.0.0")], "alias string, target string, current string, removed_in string")
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey") % 10).alias("name"))
    return ledger.resolve_aliases(names, aliases).groupBy("name", "resolved", "deprecated", "removed").agg(F.count("*").alias("n"))


@query("scope_aliases", """
SELECT p_partkey, list_extract(['all_tissues', 'all_tissues', 'blood_plasma', 'blood_plasma', 'blood_plasma'], CAST(p_partkey % 5 + 1 AS INT)) AS scope, list_extract(['super_class', 'super_class', 'main_class', 'sub_class', 'pathway'], CAST(p_partkey % 5 + 1 AS INT)) AS level FROM part""")
def scope_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of scopes and levels in any case and spelling, by the same tables that refuse unknown ones."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k, intake.resolved(_pick(["All Tissues", "all", "BLOOD", " plasma", "blood-plasma"], k), intake.SCOPES).alias("scope"), intake.resolved(_pick(["super", "Super-Class", "main", "sub class", "Pathway "], k), intake.LEVELS).alias("level"))


ADDUCTS = [("[M+H]+", "M+H", "true"), ("[M+Cl]-", "M.Cl", "true"), ("M+Na", "[M+H]+", "false"), ("[2M+H]+", "2m + h", "true"), ("[M+2H]2+", "M+2H", "true"), ("M-H", " ", "false"), ("[M-H]-", "m-h", "true")]


@query("adduct_echoes", f"""
SELECT p_partkey, {_picked([a for a, _, _ in ADDUCTS], 'p_partkey')} AS requested, {_picked([b for _, b, _ in ADDUCTS], 'p_partkey')} AS echoed, {_picked([c for _, _, c in ADDUCTS], 'p_partkey')}::BOOLEAN AS matches, CASE p_partkey % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'differs' ELSE 'no_echo' END AS echo FROM part""")
def adduct_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ion that a service echoes is the one that was asked for, and whether a name came back."""
    k = F.col("p_partkey")
    asked, echoed = _pick([a for a, _, _ in ADDUCTS], k), _pick([b for _, b, _ in ADDUCTS], k)
    named = F.when(k % 4 == 0, F.concat(F.lit(" "), F.upper("p_name"))).when(k % 4 == 1, F.concat("p_name", F.lit("?"))).when(k % 4 == 2, F.lit(" "))
    return table(spark, sf_dir, "part").select(k, asked.alias("requested"), echoed.alias("echoed"), X.adduct_matches(asked, echoed).alias("matches"), X.echo_status(F.col("p_name"), named).alias("echo"))


ACCESSIONS = [("ST003662", "true"), (" st000001", "true"), ("ST12345", "false"), ("MWB-7", "true"), ("MTBLS1", "false"), (None, "false"), ("xST003662", "false"), ("", "false")]


@query("accession_kinds", f"""
SELECT c_custkey, {_picked([b for _, b in ACCESSIONS], 'c_custkey')}::BOOLEAN AS is_workbench, coalesce(nullif(trim({_picked([a for a, _ in ACCESSIONS], 'c_custkey')}), ''), nullif(trim({_picked(BLANKS, 'c_custkey')}), ''), c_name) AS first_filled FROM customer""")
def accession_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessions of one repository, and the first filled one of several columns."""
    k = F.col("c_custkey")
    accession = _pick([a for a, _ in ACCESSIONS], k)
    return table(spark, sf_dir, "customer").select(k, X.is_mw_accession(accession).alias("is_workbench"), X.first_filled(accession, _pick(BLANKS, k), F.col("c_name")).alias("first_filled"))


@query("published_numbers", """
WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN -1e-7 WHEN 3 THEN -l_discount / 3 ELSE l_extendedprice / 7 END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(x) THEN round(x, 4) + 0.0 END AS published, CASE WHEN isfinite(x) THEN 1 / (round(x, 4) + 0.0) = '-inf'::DOUBLE ELSE false END AS negative_zero FROM x""")
def published_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded numbers without negative zero; what isn't finite is NULL."""
    k = F.col("l_orderkey") % 6
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(-1e-7)).when(k == 3, -F.col("l_discount") / 3).otherwise(F.col("l_extendedprice") / 7)
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stats.published(x, 4).alias("published"))
    return out.withColumn("negative_zero", F.coalesce((F.col("published") == 0) & (F.col("published").cast("string") == "-0.0"), F.lit(False)))


INPUTS = [
    ("hmdb_id", " hmdb42", "HMDB0000042", "zero_padded_hmdb_id:hmdb42->HMDB0000042"), ("hmdb_id", "HMDB0000042", "HMDB0000042", "none"), ("hmdb_id", "HMDB00123456789", "HMDB123456789", "zero_padded_hmdb_id:HMDB00123456789->HMDB123456789"), ("hmdb_id", "42", "42", "none"), ("hmdb_id", "HMDB000", "HMDB0000000", "zero_padded_hmdb_id:HMDB000->HMDB0000000"),
    ("chebi_id", "chebi: 17", "17", "stripped_chebi_prefix:chebi: 17->17"), ("chebi_id", "17", "17", "none"), ("inchi_key", "abc-def-g", "ABC-DEF-G", "upper_cased_inchi_key:abc-def-g->ABC-DEF-G"), ("kegg_id", "c00186", "C00186", "upper_cased_kegg_id:c00186->C00186"), ("kegg_id", "C00186", "C00186", "none"),
    ("pubchem_cid", " 612 ", "612", "none"), ("regno", "", "", "none"),
]


@query("compound_inputs", f"SELECT p_partkey, {_picked([i for i, _, _, _ in INPUTS], 'p_partkey')} AS item, {_picked([v for _, _, v, _ in INPUTS], 'p_partkey')} AS value, {_picked([a for _, _, _, a in INPUTS], 'p_partkey')} AS applied FROM part")
def compound_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers as a service takes them, each with what was changed."""
    k = F.col("p_partkey")
    item = _pick([i for i, _, _, _ in INPUTS], k)
    return table(spark, sf_dir, "part").select(k, item.alias("item"), X.compound_input(item, _pick([v for _, v, _, _ in INPUTS], k)).alias("r")).select("p_partkey", "item", "r.value", "r.applied")


METADATA = [
    ("Homo sapiens", "treadmill running", "", "human,exercise"), ("humanoid", "trained", "VO2max", "cpet"), ("Human plasma", "Accelerometry; DXA", None, "human,actigraphy,body_composition"), ("mouse", "genotyped; Genetics", "high-fat diet", "genetics,diet"), ("rerun", "outrun", "foods", ""),
    ("RUN", "lean mass and food", "oxygen consumption", "exercise,cpet,body_composition,diet"), ("", None, "", ""), ("body  composition", "actigraphy.", "Nutrition", "actigraphy,diet"),
]
_FLAGS = ("human", "exercise", "actigraphy", "genetics", "cpet", "body_composition", "diet")


@query("publication_flags", f"WITH f AS (SELECT s_suppkey, {_picked([f for _, _, _, f in METADATA], 's_suppkey')} AS f FROM supplier) SELECT s_suppkey, " + ", ".join(f"list_contains(string_split(f, ','), '{n}') AS {n}" for n in _FLAGS) + ", true AS metabolomics FROM f")
def publication_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags of a study from title, summary and factors."""
    k = F.col("s_suppkey")
    parts = [_pick([m[i] for m in METADATA], k) for i in range(3)]
    return table(spark, sf_dir, "supplier").select(k, *[c.alias(n) for n, c in screening.publication_flags(*parts).items()])

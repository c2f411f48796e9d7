"""Rule queries: catalog, crosswalk and screening rules on records that are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.collections import factor_map, modalities_from_flags
from ..operators import catalog, entities, screening
from ..registry import query, table

# A study is a customer, its repository record an order of his; flags are bits of his key.
_STUDY = """
studies AS (
  SELECT c.c_custkey AS study_id, c_custkey % 2 = 0 AS exercise, c_custkey % 3 = 0 AS actigraphy, c_custkey % 5 = 0 AS genetics, c_custkey % 7 = 0 AS cpet, c_custkey % 4 = 1 AS body_composition, c_custkey % 6 = 1 AS diet,
    c_custkey % 11 <> 0 AS human, c_custkey % 13 <> 0 AS metabolomics, CASE WHEN c_custkey % 9 = 0 THEN 'not_available' ELSE 'ACC' || c_custkey END AS repository_accession,
    CASE WHEN o.k IS NULL THEN NULL WHEN c_custkey % 8 = 0 THEN 'Metabolomics Workbench' ELSE 'Other' END AS repository, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'ACC' || o.k END AS accession,
    CASE o.s WHEN 'O' THEN 'public' WHEN 'F' THEN 'restricted_metadata_only' ELSE 'not_available' END AS public_status, o.k % 4 <> 0 AS has_metadata, o.k % 5 <> 0 AS has_codebook, o.k % 3 <> 0 AS has_data_files,
    CASE WHEN o.k % 7 = 0 THEN 'unknown' ELSE 'LC-MS' END AS assay_platform, CASE WHEN o.k % 2 = 0 THEN 'blood plasma' ELSE 'urine' END AS sample_matrix, CASE WHEN o.k % 6 = 0 THEN 'not_reported' ELSE 'fasting' END AS biospecimen_timing,
    CASE WHEN o.k % 9 <> 0 THEN CAST(o.k % 300 AS INT) END AS sample_size
  FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY ALL) o ON o.o_custkey = c.c_custkey)"""


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("k"), F.min_by("o_orderstatus", "o_orderkey").alias("s"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left")
    key, k = F.col("c_custkey"), F.col("k")
    return c.select(
        key.alias("study_id"), (key % 2 == 0).alias("exercise"), (key % 3 == 0).alias("actigraphy"), (key % 5 == 0).alias("genetics"), (key % 7 == 0).alias("cpet"), (key % 4 == 1).alias("body_composition"), (key % 6 == 1).alias("diet"),
        (key % 11 != 0).alias("human"), (key % 13 != 0).alias("metabolomics"), F.when(key % 9 == 0, "not_available").otherwise(F.concat(F.lit("ACC"), key)).alias("repository_accession"),
        F.when(k.isNull(), None).when(key % 8 == 0, "Metabolomics Workbench").otherwise("Other").alias("repository"), F.when(key % 10 == 0, "").otherwise(F.concat(F.lit("ACC"), k)).alias("accession"),
        F.when(F.col("s") == "O", "public").when(F.col("s") == "F", "restricted_metadata_only").otherwise("not_available").alias("public_status"), (k % 4 != 0).alias("has_metadata"), (k % 5 != 0).alias("has_codebook"), (k % 3 != 0).alias("has_data_files"),
        F.when(k % 7 == 0, "unknown").otherwise("LC-MS").alias("assay_platform"), F.when(k % 2 == 0, "blood plasma").otherwise("urine").alias("sample_matrix"), F.when(k % 6 == 0, "not_reported").otherwise("fasting").alias("biospecimen_timing"),
        F.when(k % 9 != 0, (k % 300).cast("int")).alias("sample_size"),
    )


_FLAGS = """
flags AS (SELECT *, repository IS NOT NULL AS has,
  list_filter([CASE WHEN CASE WHEN repository IS NOT NULL THEN coalesce(accession, '') ELSE repository_accession END IN ('', 'not_available') THEN 'no_repository_accession' END, CASE WHEN repository IS NULL AND metabolomics THEN 'no_repository_record' END,
   CASE WHEN repository IS NOT NULL AND public_status = 'restricted_metadata_only' AND NOT has_metadata THEN 'restricted_data_without_metadata' END, CASE WHEN repository IS NOT NULL AND public_status = 'not_available' THEN 'repository_data_not_available' END,
   CASE WHEN repository IS NOT NULL AND NOT has_metadata THEN 'no_downloadable_metadata' END, CASE WHEN repository IS NOT NULL AND NOT has_codebook THEN 'no_variable_dictionary_or_codebook' END, CASE WHEN repository IS NOT NULL AND NOT has_data_files THEN 'no_data_files' END,
   CASE WHEN repository IS NOT NULL AND assay_platform = 'unknown' THEN 'unclear_assay_platform' END, CASE WHEN repository IS NOT NULL AND biospecimen_timing = 'not_reported' THEN 'unclear_biospecimen_timing' END, CASE WHEN repository IS NOT NULL AND sample_size IS NULL THEN 'sample_size_not_reported' END], lambda x: x IS NOT NULL) AS f FROM studies),
mirage AS (SELECT *, list_has_any(f, ['no_repository_accession', 'no_downloadable_metadata', 'no_variable_dictionary_or_codebook', 'restricted_data_without_metadata', 'repository_data_not_available']) AS is_mirage FROM flags)"""


@query("mirage_flags", f"WITH {_STUDY}, {_FLAGS} SELECT study_id, array_to_string(f, ';') AS flags, is_mirage FROM mirage")
def mirage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = catalog.mirage_flags(F.col("repository").isNotNull())
    return studies(spark, sf_dir).select("study_id", F.array_join(flags, ";").alias("flags"), catalog.is_mirage(flags).alias("is_mirage"))


@query("rule_recommend", f"""
WITH {_STUDY}, {_FLAGS},
x AS (SELECT *, NOT (human AND metabolomics) OR (has AND repository = 'Metabolomics Workbench' AND sample_matrix <> 'blood plasma') AS out,
 0.40 + 0.12 * exercise::INT + 0.12 * actigraphy::INT + 0.04 * (exercise AND actigraphy)::INT + 0.10 * genetics::INT + 0.08 * cpet::INT + 0.05 * body_composition::INT + 0.05 * diet::INT + 0.05 * (repository_accession <> 'not_available')::INT
 + CASE WHEN has THEN 0.03 * has_metadata::INT + 0.03 * has_codebook::INT + 0.02 * has_data_files::INT + 0.02 * (sample_size IS NOT NULL)::INT + 0.01 * (assay_platform <> 'unknown')::INT + 0.01 * (biospecimen_timing <> 'not_reported')::INT ELSE 0 END AS s FROM mirage)
SELECT study_id, CAST(CASE WHEN out THEN 0 ELSE least(round(s, 3), 1.0) END AS DOUBLE) AS score,
 CASE WHEN out THEN 'excluded' WHEN is_mirage THEN 'mirage' WHEN exercise OR actigraphy OR cpet THEN 'direct_match' WHEN genetics OR body_composition OR diet THEN 'enrichment_candidate' ELSE 'complementary' END AS recommendation_class FROM x""")
def rule_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.recommend(studies(spark, sf_dir)).select("study_id", "score", "recommendation_class")


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = studies(spark, sf_dir).filter("repository is not null")
    names = ("metabolomics", "exercise", "actigraphy", "genetics", "cpet", "body_composition", "diet")
    return s.withColumn("modalities", modalities_from_flags({n: F.col(n) for n in names})).withColumn("human", F.when(F.col("study_id") % 17 != 0, F.col("human"))).withColumn("documented_absent_modalities", F.when(F.col("study_id") % 4 == 0, F.array(F.lit("genetics"))))


_DATA = f"""WITH {_STUDY}, d AS (SELECT * REPLACE (CASE WHEN study_id % 17 <> 0 THEN human END AS human), exercise OR actigraphy AS active, coalesce(sample_size > 0, false) AS sampled FROM studies WHERE repository IS NOT NULL)"""


@query("rule_quality", _DATA + """,
q AS (SELECT *, least(1.0, 0.4 + 0.2 * coalesce(human, false)::INT + CASE WHEN sampled THEN CASE WHEN sample_size >= 100 THEN 0.2 ELSE 0.1 END ELSE 0 END + 0.2 * (active AND metabolomics)::INT) AS rigor,
 round((has_metadata::INT + has_codebook::INT + has_data_files::INT + (assay_platform <> 'unknown')::INT + 1 + (biospecimen_timing <> 'not_reported')::INT + sampled::INT) / 7.0, 3) AS completeness,
 CASE WHEN metabolomics THEN 0.4 + 0.25 * (assay_platform <> 'unknown')::INT + 0.15 + 0.20 * has_data_files::INT ELSE 0 END AS mq FROM d)
SELECT study_id, CASE WHEN human IS NULL THEN 'human_status_unknown' WHEN human THEN 'in_scope_human' ELSE 'out_of_scope_non_human' END AS scope_status, CAST(completeness AS DOUBLE) AS metadata_completeness, CAST(mq AS DOUBLE) AS metabolomics_quality,
 CASE WHEN human IS NULL OR human THEN CAST(round(round(0.15 * rigor + 0.15 * completeness + 0.15 * mq + 0.10 * CASE WHEN actigraphy THEN 0.85 WHEN exercise THEN 0.70 ELSE 0.25 END + 0.10 * CASE WHEN genetics THEN 0.8 ELSE 0.35 END + 0.10 * CASE WHEN cpet THEN 0.85 ELSE 0.25 END
  + 0.05 * CASE WHEN body_composition THEN 0.80 ELSE 0.30 END + 0.05 * CASE WHEN diet THEN 0.75 ELSE 0.30 END + 0.10 * CASE WHEN biospecimen_timing <> 'not_reported' AND active THEN 0.80 ELSE 0.35 END + 0.05 * CASE WHEN has_codebook AND has_metadata THEN 0.85 ELSE 0.25 END, 10), 3) AS DOUBLE) END AS overall_score FROM q""")
def rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.quality(datasets(spark, sf_dir)).select("study_id", "scope_status", "metadata_completeness", "metabolomics_quality", "overall_score")


@query("rule_alignment", _DATA + """,
m AS (SELECT *, coalesce(human, false)::INT + metabolomics::INT + active::INT + (biospecimen_timing <> 'not_reported')::INT + 1 + (assay_platform <> 'unknown')::INT + (genetics OR study_id % 4 = 0)::INT + cpet::INT + body_composition::INT + diet::INT + has_codebook::INT AS met FROM d),
s AS (SELECT *, round(met / 11.0, 3) AS score FROM m)
SELECT study_id, CAST(score AS DOUBLE) AS alignment_score, CASE WHEN NOT coalesce(human, false) THEN 'not_feasible' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.65 THEN 'moderate' WHEN score >= 0.40 THEN 'low' ELSE 'not_feasible' END AS alignment_tier, CAST(11 - met AS BIGINT) AS missing FROM s""")
def rule_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.alignment(datasets(spark, sf_dir)).select("study_id", "alignment_score", "alignment_tier", F.size("missing_elements").cast("bigint").alias("missing"))


# Variable cards from parts: a name, a label, a unit and a modality by key.
_NAMES = ("VO2max", "Peak VO₂", "daily steps", "wrist_steps_14d", "MVPA min", "Age", "Gender", "BMI", "fasting glucose", "Insulin level", "total lean mass", "stage", "p_size")
_UNITS = ("mL/kg/min", "steps/day", "min/day", "years", "category", "kg/m^2", "mmol/L", "mg/dL", "", "kg")
_MODS = ("cpet", "actigraphy", "demographics", "body_composition", "metabolomics", "clinical")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("card_id"), pick(_NAMES, k).alias("source_variable"), F.col("p_name").alias("label"), pick(_UNITS, F.expr("p_partkey div 13")).alias("unit"), pick(_MODS, F.expr("p_partkey div 7")).alias("modality"), F.when(k % 5 == 0, "unknown").otherwise("baseline").alias("timing"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SYN = ", ".join(f"({i}, '{v}', '{s}', '{u}', {_sql_list(m)})" for i, (v, (syn, u, m)) in enumerate(catalog.COMMON_VARIABLES.items()) for s in syn)


_CROSSWALK = f"""
WITH c AS (SELECT p_partkey AS card_id, {_sql_list(_NAMES)}[1 + p_partkey % {len(_NAMES)}] AS source_variable, p_name AS label, {_sql_list(_UNITS)}[1 + (p_partkey // 13) % {len(_UNITS)}] AS unit, {_sql_list(_MODS)}[1 + (p_partkey // 7) % {len(_MODS)}] AS modality, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE 'baseline' END AS timing FROM part),
n AS (SELECT *, trim(regexp_replace(replace(lower(trim(source_variable)), 'vo₂', 'vo2'), '[^a-z0-9]+', '_', 'g'), '_') AS nv, trim(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '_') AS nl FROM c),
syn(prio, v, s, u, mods) AS (VALUES {_SYN}),
hit AS (SELECT card_id, v, u, mods, prio, CASE WHEN nv = s OR nl = s THEN 0 WHEN contains('_' || nv || '_', '_' || s || '_') OR contains('_' || s || '_', '_' || nv || '_') OR contains('_' || nl || '_', '_' || s || '_') OR contains('_' || s || '_', '_' || nl || '_') THEN 1 END AS kind FROM n, syn),
best AS (SELECT card_id, arg_min(v, kind * 100 + prio) AS v, arg_min(u, kind * 100 + prio) AS u, arg_min(mods, kind * 100 + prio) AS mods FROM hit WHERE kind IS NOT NULL GROUP BY ALL),
j AS (SELECT n.*, coalesce(v, 'not_mapped') AS v, mods, CASE WHEN v IS NULL OR unit = '' THEN 'not_available' WHEN lower(unit) = lower(u) THEN 'identity' WHEN v = 'fasting_glucose' AND lower(unit) = 'mmol/l' THEN 'multiply_by_18.0182' ELSE 'unit_conversion_requires_review' END AS transform FROM n LEFT JOIN best USING (card_id)),
k AS (SELECT *, transform IN ('identity', 'multiply_by_18.0182') AS uok, coalesce(list_contains(mods, modality), false) AS mok, timing <> 'unknown' AS tok, (v = 'vo2max' AND nv IN ('vo2peak', 'peak_vo2')) OR (v = 'sex' AND (nv = 'gender' OR nl = 'gender')) AS cav FROM j),
s AS (SELECT *, CAST(CASE WHEN v = 'not_mapped' THEN 0.20 ELSE greatest(0, least(round(least(0.50 + CASE WHEN nv = v THEN 0.20 ELSE 0.12 END + CASE WHEN uok THEN 0.12 ELSE -0.12 END + CASE WHEN mok THEN 0.10 ELSE -0.22 END + CASE WHEN tok THEN 0.04 ELSE -0.08 END, CASE WHEN cav THEN 0.78 ELSE 9 END), 2), 0.99)) END AS DOUBLE) AS confidence FROM k),
x AS (SELECT card_id, v AS common_variable, transform, confidence, CASE WHEN v = 'not_mapped' OR NOT mok THEN 'rejected' WHEN confidence >= 0.90 AND uok AND tok AND (v <> 'vo2max' OR nv = 'vo2max') THEN 'accepted' WHEN confidence >= 0.40 THEN 'requires_human_review' ELSE 'rejected' END AS review_status , v, cav FROM s)"""


@query("crosswalk_tokens", _CROSSWALK + " SELECT card_id, common_variable, transform, confidence, review_status FROM x")
def crosswalk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.crosswalk(cards(spark, sf_dir)).select("card_id", "common_variable", "transform", "confidence", "review_status")


@query("crosswalk_review_queue", _CROSSWALK + """,
y AS (SELECT *, CASE WHEN review_status = 'accepted' THEN 'none' WHEN v = 'vo2max' AND cav THEN 'confirm_exercise_protocol' WHEN v = 'sex' AND cav THEN 'confirm_sex_or_gender' WHEN transform = 'unit_conversion_requires_review' THEN 'confirm_unit_conversion'
 WHEN review_status = 'rejected' THEN 'rejected_by_guardrail' ELSE 'insufficient_confidence_or_metadata' END AS review_reason FROM x)
SELECT review_status, review_reason, count(*) AS n, count(*) FILTER (review_status = 'accepted' AND transform IN ('identity', 'multiply_by_18.0182')) AS planned FROM y GROUP BY ALL""")
def crosswalk_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review reasons by status, and how many mappings the transform plan lets through."""
    m = catalog.review_reason(catalog.crosswalk(cards(spark, sf_dir)))
    return m.groupBy("review_status", "review_reason").agg(F.count("*").alias("n"), F.count_if(catalog.approved()).alias("planned"))


@query("transform_plan", _CROSSWALK + " SELECT card_id, common_variable, transform FROM x WHERE review_status = 'accepted' AND transform IN ('identity', 'multiply_by_18.0182')")
def transform_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only mappings that may be transformed."""
    return catalog.transform_plan(catalog.crosswalk(cards(spark, sf_dir))).select("card_id", "common_variable", "transform")


# Bibliographic records from documents: titles and notes by key, identifiers that some of them share.
_NOTES = ("human participants after exercise training", "mice on a treadmill", "plasma metabolomics of patients", "polymer scaffold coating", "systematic sweep", "metabolite in human cohort; data at ST003662 and MTBLS12", "")
_TYPES = ("journal-article", "review", "preprint", "editorial", "retracted article", "", "research-article")
_RECORD = f"""
records AS (SELECT doc_id, source AS source_system, 'Title ' || (doc_id // 2) || ' Lac-Phe' AS title, {_sql_list(_NOTES)}[1 + doc_id % {len(_NOTES)}] AS abstract, source AS journal, CAST(2000 + doc_id % 20 AS VARCHAR) AS publication_year, {_sql_list(_TYPES)}[1 + (doc_id // 3) % {len(_TYPES)}] AS publication_types,
 doc_id % 5 = 2 AS is_preprint, CASE WHEN doc_id % 4 = 0 THEN '10.1000/' || (doc_id // 8) END AS doi, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id // 6 AS VARCHAR) END AS pmid FROM documents)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("source_system"), F.concat(F.lit("Title "), F.expr("doc_id div 2"), F.lit(" Lac-Phe")).alias("title"), pick(_NOTES, d).alias("abstract"), F.col("source").alias("journal"), (2000 + d % 20).cast("string").alias("publication_year"),
        pick(_TYPES, F.expr("doc_id div 3")).alias("publication_types"), (d % 5 == 2).alias("is_preprint"), F.when(d % 4 == 0, F.concat(F.lit("10.1000/"), F.expr("doc_id div 8"))).alias("doi"), F.when(d % 3 == 0, F.expr("doc_id div 6").cast("string")).alias("pmid"),
        F.lit(None).cast("string").alias("pmcid"), F.lit(None).cast("string").alias("linked_published_doi"), F.lit(None).cast("string").alias("cited_by_count"), F.lit("").alias("notes"),
    )


_ENTITIES = f"""
WITH RECURSIVE {_RECORD},
keys AS (SELECT doc_id, 'doi:' || doi AS k FROM records WHERE doi IS NOT NULL UNION ALL SELECT doc_id, 'pmid:' || pmid FROM records WHERE pmid IS NOT NULL
 UNION ALL SELECT doc_id, 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || publication_year FROM records WHERE doi IS NULL AND pmid IS NULL),
near AS (SELECT DISTINCT a.k AS a, b.k AS b FROM keys a JOIN keys b USING (doc_id)),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
comp AS (SELECT a, min(b) AS entity FROM reach GROUP BY a),
e AS (SELECT doc_id, min(entity) AS entity FROM keys JOIN comp ON a = k GROUP BY doc_id)"""


@query("entity_dedup", _ENTITIES + " SELECT doc_id, entity FROM e")
def entity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.assign(records(spark, sf_dir)).select("doc_id", "entity")


@query("entity_merge", _ENTITIES + """,
o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY is_preprint, -length(abstract), source_system, title, publication_year, journal, coalesce(doi, ''), coalesce(pmid, '')) AS k FROM records JOIN e USING (doc_id)),
c AS (SELECT entity, [CASE WHEN count(DISTINCT lower(title)) > 1 THEN 'title: ' || array_to_string(list_sort(list(DISTINCT lower(title))), ' != ') END, CASE WHEN count(DISTINCT publication_year) > 1 THEN 'publication_year: ' || array_to_string(list_sort(list(DISTINCT publication_year)), ' != ') END,
 CASE WHEN count(DISTINCT lower(journal)) > 1 THEN 'journal: ' || array_to_string(list_sort(list(DISTINCT lower(journal))), ' != ') END] AS found FROM o GROUP BY entity)
SELECT entity, count(*) AS member_count, arg_min(title, k) AS title, arg_min(publication_year, k) AS publication_year, arg_min(journal, k) AS journal, arg_min(doi, k) FILTER (doi IS NOT NULL) AS doi, arg_min(pmid, k) FILTER (pmid IS NOT NULL) AS pmid,
 arg_min(abstract, k) FILTER (trim(abstract) <> '') AS abstract, arg_min(publication_types, k) FILTER (trim(publication_types) <> '') AS publication_types, bool_and(is_preprint) AS is_preprint, bool_or(is_preprint) AS has_preprint_version,
 array_to_string(list_sort(list(DISTINCT source_system)), '; ') AS source_systems, any_value(array_to_string(list_filter(found, lambda x: x IS NOT NULL), '; ')) AS conflicts FROM o JOIN c USING (entity) GROUP BY entity""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records: the best member, blanks filled from the others, disagreements listed."""
    m = entities.merge(entities.assign(records(spark, sf_dir)))
    return m.select("entity", "member_count", "title", "publication_year", "journal", "doi", "pmid", "abstract", "publication_types", "is_preprint", "has_preprint_version", "source_systems", "conflicts")


_BANK_SQL = ", ".join(f"regexp_matches(txt, '{'|'.join('(?:' + p + ')' for p in screening.BANKS[b])}') AS x_{b}" for b in ("human", "rodent", "exercise", "metabolomics", "material", "biological"))
_SCREEN = f"""
WITH {_RECORD}, t AS (SELECT *, lower(title || ' ' || abstract || ' ' || journal || ' ') AS txt, abstract <> '' AS has_abs FROM records), f AS (SELECT *, {_BANK_SQL} FROM t),
g AS (SELECT *, CASE WHEN is_preprint THEN 'preprint_not_peer_reviewed' WHEN publication_types LIKE '%retract%' THEN 'retracted_or_retraction_notice' WHEN publication_types LIKE '%review%' THEN 'peer_reviewed_secondary_synthesis' WHEN publication_types LIKE '%editorial%' THEN 'editorial_or_commentary'
  WHEN publication_types LIKE '%-article%' THEN 'peer_reviewed_primary' ELSE 'unknown_publication_type' END AS tier,
  CASE WHEN x_human AND x_rodent THEN 'human_and_animal' WHEN x_human THEN 'human' WHEN x_rodent THEN 'rodent' ELSE 'not_stated_in_retrieved_text' END AS species,
  CASE WHEN x_material AND NOT x_biological THEN 'flagged_non_metabolite_homonym_context' WHEN x_material THEN 'mixed_material_and_biological_context' ELSE 'no_homonym_signal' END AS homonym FROM f),
c AS (SELECT *, CASE WHEN tier IN ('retracted_or_retraction_notice', 'editorial_or_commentary') THEN 'not_primary_evidence' WHEN NOT has_abs AND NOT x_metabolomics AND NOT x_exercise THEN 'screening_uncertain_insufficient_text' WHEN tier = 'peer_reviewed_secondary_synthesis' THEN 'secondary_synthesis'
  WHEN species = 'rodent' THEN 'animal_or_invitro_mechanistic' WHEN x_human AND x_exercise THEN 'direct_human_exercise' WHEN x_human THEN 'human_non_exercise_context' WHEN species = 'not_stated_in_retrieved_text' THEN 'screening_uncertain_insufficient_text' ELSE 'non_relevant_context' END AS screen_class FROM g),
r AS (SELECT *, CASE WHEN screen_class IN ('screening_uncertain_insufficient_text', 'direct_human_exercise') OR tier IN ('preprint_not_peer_reviewed', 'unknown_publication_type', 'retracted_or_retraction_notice') OR homonym <> 'no_homonym_signal' THEN 'requires_human_review' ELSE 'advisory_only' END AS review_status FROM c)"""


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(records(spark, sf_dir).withColumn("has_conflicts", F.lit(False)), ("Lac-Phe",))


@query("screen_documents", _SCREEN + """
SELECT doc_id, screen_class, tier AS evidence_tier, species AS species_scope, homonym AS homonym_risk, review_status, CASE WHEN x_human THEN 'yes:text_inference' WHEN has_abs THEN 'no_signal:text_inference' ELSE 'unknown:no_abstract_text' END AS human_evidence,
 CASE WHEN abstract LIKE '%ST003662%' THEN 'metabolights:MTBLS12;metabolomics_workbench:ST003662' ELSE '' END AS accessions FROM r""")
def screen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = screened(spark, sf_dir)
    return s.select("doc_id", "screen_class", "evidence_tier", "species_scope", "homonym_risk", "review_status", "human_evidence", F.array_join("accessions", ";").alias("accessions"))


@query("screen_escalations", _SCREEN + """
SELECT doc_id, unnest(list_filter([CASE WHEN screen_class = 'screening_uncertain_insufficient_text' THEN 'unscreenable_record' END, CASE WHEN tier = 'preprint_not_peer_reviewed' THEN 'preprint_without_peer_review' END, CASE WHEN tier = 'retracted_or_retraction_notice' THEN 'retraction_flag_in_publication_type' END,
 CASE WHEN homonym <> 'no_homonym_signal' THEN 'possible_name_homonym' END, CASE WHEN screen_class = 'direct_human_exercise' AND abstract NOT LIKE '%ST003662%' THEN 'unresolved_data_deposition' END], lambda x: x IS NOT NULL)) AS escalation FROM r""")
def screen_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.escalations(screened(spark, sf_dir), "doc_id")


@query("screen_summary", _SCREEN + """
SELECT 'screen_class' AS field, screen_class AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'evidence_tier', tier, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'species_scope', species, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'review_status', review_status, count(*) FROM r GROUP BY 2""")
def screen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("screen_class", "evidence_tier", "species_scope", "review_status")
    long = screened(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x"))
    return long.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


@query("html_text_length", """
WITH u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS h FROM pages),
s AS (SELECT page_id, regexp_replace(h, '<[^>]+>', ' ', 'g') AS h FROM u),
v AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(h, '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS h FROM s)
SELECT page_id, length(trim(regexp_replace(h, '\\s+', ' ', 'g'))) AS n, md5(trim(regexp_replace(h, '\\s+', ' ', 'g'))) AS digest FROM v""")
def html_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("bigint").alias("n"), F.md5(text).alias("digest"))


@query("json_props", """
SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON column with an explicit schema: one parse, no inference pass."""
    k = F.from_json("props", "k bigint")["k"].cast("string")
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("factor_map", """
SELECT user_id % 3 AS grp, 'T' || (user_id % 3) AS timepoint, 'late' AS sex, count(*) AS n FROM events GROUP BY ALL""")
def factor_map_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key:value | key:value`` strings as maps; of equal keys the last wins."""
    raw = F.concat(F.lit("Time: T"), F.col("user_id") % 3, F.lit(" | Sex: early | junk | SEX: late"))
    m = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp"), factor_map(raw).alias("m"))
    return m.groupBy("grp", F.col("m")["time"].alias("timepoint"), F.col("m")["sex"].alias("sex")).agg(F.count("*").alias("n"))

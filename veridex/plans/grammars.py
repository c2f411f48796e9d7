"""Queries over every row of the fixed tables: each value is expected by hand, and stands next to one that doesn't match.

The rows of a driver's table are numbered, and a row takes the example of its number; the SQL lists what is expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ledger, screening
from ..registry import query, table
from ..sources import responses
from .oracle_kit import example, example_sql


def expected(rows: list[tuple], source: str, key: str, *names: str) -> str:
    """SQL that counts the expected columns of the examples that the rows of a table take."""
    values = ", ".join(f"{example_sql([r[k + 1] for r in rows], key)} AS {name}" for k, name in enumerate(names))
    return f"SELECT {example_sql([r[0] for r in rows], key)} AS given, {values}, count(*) AS n FROM {source} GROUP BY ALL"


def given(spark: SparkSession, sf_dir: str, rows: list[tuple], source: str, key: str, *more: int) -> DataFrame:
    """The examples as columns given, and more1, more2 ... for further inputs."""
    number = F.col(key)
    return table(spark, sf_dir, source).select(example([r[0] for r in rows], number).alias("given"), *[example([r[k] for r in rows], number).alias(f"more{i + 1}") for i, k in enumerate(more)])


NAMESPACES = [
    ("ABCDEFGHIJKLMN-OPQRSTUVWX-Y", "inchikey"), ("abcdefghijklmn-opqrstuvwx-y", "inchikey"), ("ABCDEFGHIJKLMN-OPQRSTUVWX", None),
    ("CHEBI:17234", "chebi"), ("chebi:1", "chebi"), ("CHEBI17234", None), ("HMDB0000001", "hmdb"), ("hmdb0000001", "hmdb"), ("HMDB00001", None), ("RM0000001", "refmet"), ("RM001", None),
    ("LMFA01010001", "lipidmaps"), ("LMZZ0001", "lipidmaps"), ("LMFA01", None), ("CID 123", "pubchem_cid"), ("PubChem CID:5", "pubchem_cid"), ("CID-77", "pubchem_cid"), ("CIDX", None),
    ("MTBLS1", "metabolights"), ("MTBLS", None), ("ST000001", "metabolomics_workbench"), (" st0000017 ", "metabolomics_workbench"), ("ST00001", None), ("MTBKS12", "metabobank"), ("MTBK12", None),
    ("PXD000001", "pride"), ("PXD00001", None), ("MSV000012345", "massive"), ("MSV00001234", None), ("R-HSA-123", "reactome"), ("R-HS-123", None), ("RHEA:10", "rhea"), ("RHEA10", None),
    ("rs7412", "rsid"), ("rs", None), ("ENSG00000130203", "ensembl_gene"), ("ENSMUSG00000002985.5", "ensembl_gene"), ("ENST00000130203", None),
    ("GeneID:348", "entrez_gene"), ("entrez 348", "entrez_gene"), ("NCBIGENE_348", "entrez_gene"), ("348", None), ("MGP000001", "mgp_id"), ("MGP0001", None),
    ("RegNo 12", "metabolomics_workbench_regno"), ("MWREGNO:12", "metabolomics_workbench_regno"), ("REG 12", None), ("NM_005502", "refseq"), ("XP_0012.3", "refseq"), ("NX_0012", None),
    ("R00001", "kegg_reaction"), ("R0001", None), ("P02649", "uniprot"), ("A0A0A0", "uniprot"), ("AAAAAA", None), ("B1XC03", "uniprot"), ("CHEMBL25", "chembl"), ("CHEMBL", None),
    ("10.1000/xyz123", "doi"), ("https://doi.org/10.1000/xyz", "doi"), ("doi:10.1000/a", "doi"), ("10.1/x", None), ("PMC1234567", "pmcid"), ("PMC12345", None), ("C00031", "kegg_compound"), ("C0031", None),
    ("hsa00010", "kegg_pathway"), ("map00010", "kegg_pathway"), ("mmu00010", None), ("GO:0001234", None), ("APOE", None), ("", None), (None, None),
]


@query("namespace_infer", expected(NAMESPACES, "part", "p_partkey", "namespace"))
def namespace_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each identifier grammar in two cases, and near misses that no grammar takes."""
    df = given(spark, sf_dir, NAMESPACES, "part", "p_partkey")
    return df.groupBy("given", X.namespace(F.col("given")).alias("namespace")).agg(F.count("*").alias("n"))


_YES, _MAYBE, _NO = "title_supports_exercise_context", "title_ambiguous_term_only", "title_no_exercise_term"
TITLES = [
    ("Exercise and lactate", _YES, "exercise", "", True), ("She exercised", _YES, "exercise", "", True), ("Exercisers", _NO, "", "", True), ("Post-exercise urine", _YES, "exercise;post_exercise", "", True),
    ("Exercise-induced change", _YES, "exercise;exercise_induced", "", True), ("Training effects", _YES, "training", "", True), ("training-induced adaptation", _YES, "training;training_induced", "", True), ("trainingless", _NO, "", "", True),
    ("Elite athletes", _YES, "athlete", "", True), ("decathlon", _NO, "", "", False), ("Sports medicine", _YES, "sport", "", True), ("transport of lipids", _NO, "", "", True), ("Endurance in mice", _YES, "endurance", "", False),
    ("HIIT and plasma", _YES, "hiit_or_interval", "", False), ("High-intensity interval work", _YES, "hiit_or_interval", "", False), ("physical  activity and diet", _YES, "physical_activity", "", False), ("physical inactivity", _NO, "", "", False),
    ("Cardiorespiratory fitness", _YES, "cardiorespiratory_fitness", "", True), ("Fitness of yeast", _NO, "", "", True), ("A marathon", _YES, "marathon_running_cycling", "", False), ("thermal cycling", _YES, "marathon_running_cycling", "", False),
    ("running buffer", _YES, "marathon_running_cycling", "", False), ("Resistance training", _YES, "training;resistance_training", "", True), ("Training set of spectra", _MAYBE, "", "training_set_ml", True),
    ("biosignature training of a model", _MAYBE, "", "biosignature_training_ml", True), ("fitness to hypoxia", _MAYBE, "", "fitness_biological_sense", True), ("Breathing exercises", _MAYBE, "", "breathing_exercises", True),
    ("A training set of athletes", _YES, "athlete", "training_set_ml", True), ("workout logs", _NO, "", "", False), ("Liver lipids", _NO, "", "", False), ("", _NO, "", "", False),
]


@query("title_screen", expected(TITLES, "events", "event_id", "title_class", "terms", "phrases", "sweep"))
def title_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exercise term and every ambiguous phrase in titles, with look-alikes."""
    s = given(spark, sf_dir, TITLES, "events", "event_id").select("given", screening.title_screen(F.col("given")).alias("s"))
    return s.groupBy("given", F.col("s.class").alias("title_class"), "s.terms", "s.phrases", "s.sweep").agg(F.count("*").alias("n"))


TIMES = [
    ("Time:1P", "pre"), ("Group:x | time : Pre", "pre"), ("Time:Baseline", "pre"), ("Time:pre-exercise", "pre"), ("TIME:Before", "pre"), ("Time:B", "pre"), ("Time:60 min", "time_60min"), ("Time:3.5 h|Sex:F", "time_35h"),
    ("Time:blank", "unknown"), ("Time:QC | Visit:R2", "time_0"), ("Time:unknown|Visit:baseline", "pre"), ("Visit:time 60", "time_60"), ("S1_R3", "time_60"), ("S1_R3.2", "unknown"), ("S1_time-0", "time_0"), ("S1_R2_x", "time_0"),
    ("CTR2", "unknown"), ("S01_pre_1", "pre"), ("pre training", "pre"), ("Treatment:prednisone", "unknown"), ("Diagnosis:prediabetes", "unknown"), ("Sample source:Blood", "unknown"), ("S_B", "pre"), ("before", "pre"), ("Runtime:60", "unknown"), ("", "unknown"), (None, "unknown"),
]


@query("timepoint_labels", expected(TIMES, "orders", "o_orderkey", "timepoint"))
def timepoint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of factor strings and sample ids: explicit factors, whole tokens, and what only looks like one."""
    df = given(spark, sf_dir, TIMES, "orders", "o_orderkey")
    return df.groupBy("given", X.timepoint(F.col("given")).alias("timepoint")).agg(F.count("*").alias("n"))


LABELS = [
    ("ADUEndur", "EE", ""), ("EnduranceTrained", "EE", ""), ("EE", "EE", ""), ("ee/F", "EE", "female"), ("FEET", "", ""), ("ADUResist", "RE", ""), ("Resistance", "RE", ""), ("group RE", "RE", ""), ("PRE", "", ""),
    ("ADUControl", "CON", ""), ("Controls", "CON", ""), ("CON", "CON", ""), ("iCON", "", ""), ("endurance control", "EE", ""), ("Female", "", "female"), ("females", "", "female"), ("F", "", "female"), ("Male", "", "male"),
    ("M", "", "male"), ("adult males", "", "male"), ("adult_female_2", "", "female"), ("F and M", "", "female"), ("women", "", ""), ("men", "", ""), ("malekid", "", ""), ("shemale", "", ""), ("", "", ""), (None, "", ""),
]


@query("group_labels", expected(LABELS, "orders", "o_orderkey", "exercise_group", "sex"))
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercise groups and sexes of labels; what is not explicit stays blank."""
    df = given(spark, sf_dir, LABELS, "orders", "o_orderkey")
    return df.groupBy("given", X.exercise_group(F.col("given")).alias("exercise_group"), X.sex_label(F.col("given")).alias("sex")).agg(F.count("*").alias("n"))


URLS = [
    ("https://x.org/a", "https://x.org/a"), ("https://x.org/a?q=1 2&z=~*", "https://x.org/a?q=1 2&z=~*"), ("https://x.org/a?q=1%202&api_key=abc", "https://x.org/a?q=1+2&api_key=%3Credacted%3E"),
    ("https://x.org/?email=x@y.z#top", "https://x.org/?email=%3Credacted%3E#top"), ("https://x.org/?mailto=a&mailto=b&tool=t", "https://x.org/?mailto=%3Credacted%3E&mailto=%3Credacted%3E&tool=t"),
    ("https://x.org/?tool_key=&q=~*", "https://x.org/?tool_key=%3Credacted%3E&q=~%2A"), ("https://x.org/?q&api_key", "https://x.org/?q=&api_key=%3Credacted%3E"), ("https://x.org/?a=b=c&&api_key=1", "https://x.org/?a=b%3Dc&api_key=%3Credacted%3E"),
    ("https://x.org/?my_api_key=1", "https://x.org/?my_api_key=1"), ("https://x.org/#?api_key=1", "https://x.org/#?api_key=1"), ("https://x.org/?q=%zz&email=1", "https://x.org/?q=%25zz&email=%3Credacted%3E"), (None, None),
]


@query("url_redact", expected(URLS, "pages", "page_id", "url"))
def url_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked parameters, queries that stay as they are, and fragments."""
    return given(spark, sf_dir, URLS, "pages", "page_id").groupBy("given", X.redact_url(F.col("given")).alias("url")).agg(F.count("*").alias("n"))


SEGMENTS = [("fatty liver", "fatty+liver", False), ("  a \t b ", "a+b", False), ("HMGCR", "HMGCR", True), ("NM_005502", "NM_005502", True), ("A__B", "A__B", False), ("A,B", "A,B", False), ("a/b", None, False), ("a?b", None, False), ("a#b", None, False), ("5%", None, False), ("a&b", None, False), ("a;b", None, False), ("a\\b", None, False), ("", "", False), (None, None, False)]


@query("path_segments", expected(SEGMENTS, "pages", "page_id", "segment", "one_gene"))
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path segments with blanks as "+", refused where a character would break the path, and values that are one gene."""
    df = given(spark, sf_dir, SEGMENTS, "pages", "page_id")
    return df.groupBy("given", X.path_encode(F.col("given")).alias("segment"), X.single_gene(F.col("given")).alias("one_gene")).agg(F.count("*").alias("n"))


RESPONSES = [
    ('[{"a": 1}]', 200, "application/json", "ok"), ('{"a": 1}', 200, "application/json", "ok"), ('{"Row1": {"a": 1}}', 200, None, "ok"), (" [] ", 200, "application/json", "no_hits"), ("{}", 200, "application/json", "no_hits"), ("{ }", 200, "application/json", "no_hits"),
    ("null", 200, "application/json", "no_hits"), ("[1, 2]", 200, "application/json", "no_hits"), ('"text"', 200, "application/json", "no_hits"), ("", 200, "application/json", "unavailable"), (None, 200, "application/json", "unavailable"), ("oops", 200, "text/plain", "unavailable"),
    ("<html>busy</html>", 200, "application/json", "request_rejected"), ("[1]", 200, "Text/HTML; charset=utf-8", "request_rejected"), ('[{"b": 1}]', 404, "application/json", "unavailable"), ('[{"c": 1}]', 429, "application/json", "unavailable"), ('[{"d": 1}]', 500, "application/json", "unavailable"), ('[{"e": 1}]', None, "", "unavailable"),
]


@query("classify_responses", expected([(b, s) for b, _, _, s in RESPONSES], "events", "event_id", "status"))
def classify_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ok, no hits, rejected or unavailable: a failed source is never zero hits."""
    df = given(spark, sf_dir, RESPONSES, "events", "event_id", 1, 2)
    return df.groupBy("given", responses.classify(F.col("more1"), F.col("more2"), F.col("given")).alias("status")).agg(F.count("*").alias("n"))


GENE_RESPONSES = [
    ('[{"a": 1}]', 200, "ok"), ('[[{"a": 1}], []]', 200, "ok"), ("[[]]", 200, "no_hits"), ("[]", 200, "no_hits"), ('{"a": 1}', 200, "ok"), ("{}", 200, "ok"), ("null", 200, "no_hits"), ("7", 200, "no_hits"), ("  ", 200, "indeterminate_empty_body"), (None, 200, "indeterminate_empty_body"),
    ("<p>No summaries found for X</p>", 200, "gene_not_annotated"), ("<p>X not found</p>", 200, "unavailable"), ('<p>no summaries found [X]</p>[{"a": 1}]', 200, "unavailable"), ('<b>{bad}</b> {"a": [1]}', 200, "unavailable"), ("broken {", 200, "unavailable"),
    ("forbidden", 403, "unavailable"), ("error", 500, "gene_unresolved_or_source_error"), ("missing", 404, "unavailable"), ("gateway", 502, "unavailable"), ("late", None, "unavailable"),
]


@query("classify_gene_responses", expected([(b, s) for b, _, s in GENE_RESPONSES], "events", "event_id", "status"))
def classify_gene_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gene service's states, mixed and empty bodies among them."""
    df = given(spark, sf_dir, GENE_RESPONSES, "events", "event_id", 1)
    return df.groupBy("given", responses.classify_gene(F.col("more1"), F.col("given"), F.lit(True)).alias("status")).agg(F.count("*").alias("n"))


def _packets() -> list[tuple[str | None, str]]:
    """Packets and their violations, sorted and joined by "|"."""
    rows = [('{"a": [{"%s": 1}]}' % f, f"field:{f}") for f in ledger.FORBIDDEN_FIELDS]
    rows += [('{"%s": 1}' % f, f"field:{f}") for f in ("Acceptance_note", "my_rejections", "overconfidence", "transformed", "pooling_allowed", "combinable_pooling", "Risk_of_bias_total_score", "meta_analysis_effect", "pooled_mean_estimate")]
    rows += [('{"%s": "x"}' % f, f"time:{f}") for f in (*ledger.TIME_FIELDS, "start_timestamp")]
    rows += [('{"%s": 1}' % f, "") for f in ("Accepted", "pooling", "risk_of_bias", "meta_analysis", "pooled", "effect_size", "mean_pooled_effect", "timestamps", "override")]
    said = {
        "acceptance or rejection decision": ("we accept this mapping", "the study was rejected", "acceptance is recommended"), "confidence score": ("confidence: 0.9", "Confidence score is high"),
        "approved transform": ("the transformation is approved", "permitted transform"), "pooling permission": ("pooling is allowed", "authorizes the later pooling"),
        "risk-of-bias score": ("risk of bias score = 3",), "meta-analytic result": ("pooled effect 1.2", "the meta-analytic estimate: 2"),
    }
    rows += [('{"e": {"%s": "%s"}}' % (f, t), f"statement:{label}") for label, texts in said.items() for t in texts for f in ("detail",)]
    rows += [('{"intended_use": "pooling is allowed"}', "statement:pooling permission"), ('{"description": "a study rejected"}', "statement:acceptance or rejection decision"), ('{"note": "pooling is allowed"}', "")]
    rows += [('{"detail": "cannot accept this mapping"}', ""), ('{"detail": "never said so. pooling is allowed"}', "statement:pooling permission"), ('{"detail": ["pooling is allowed"]}', "")]
    rows += [('{"detail": "a \\"accepted\\": b"}', ""), ('{"x": "accepted"}', ""), ("not a packet", "not_json"), ("{}", ""), ('{"b": {"accepted": true, "created_at": "t", "detail": "pooling allowed"}}', "field:accepted|statement:pooling permission|time:created_at")]
    return rows


PACKETS = _packets()


@query("packet_violations", expected(PACKETS, "events", "event_id", "violations"))
def packet_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden fields, time fields and statements of authority in nested packets, found without a schema."""
    e = table(spark, sf_dir, "events").select("event_id", example([b for b, _ in PACKETS], F.col("event_id")).alias("given"))
    found = ledger.packet_violations(e, "event_id", "given").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list("violation")), "|").alias("violations"))
    return e.join(found, "event_id", "left").groupBy("given", F.coalesce("violations", F.lit("")).alias("violations")).agg(F.count("*").alias("n"))

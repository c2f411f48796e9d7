"""Edge rows that the driver's clean tables lack: NULL, NaN, zero, negative, repeated keys, single rows, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.functions import collections as C
from veridex.functions import text as X
from veridex.operators import assay, bh, catalog, entities, evaluate, ledger, paired, relational, screening, views
from veridex.operators.components import components
from veridex.operators.constraints import ConstraintError, duplicates, enforce


def brute_bh(p):
    order = np.argsort(p)
    q, low = np.empty(len(p)), 1.0
    for rank in range(len(p), 0, -1):
        low = min(low, p[order[rank - 1]] * len(p) / rank)
        q[order[rank - 1]] = low
    return q


def test_bh_skips_unknown_and_handles_ties(spark):
    p = [0.01, 0.04, 0.04, 0.2, None, float("nan"), 1.0, 0.0]
    rows = spark.createDataFrame(list(enumerate(p)), "i int, p_value double")
    got = {r.i: r.q_value for r in bh.adjust(rows).collect()}
    known = [i for i, v in enumerate(p) if v is not None and v == v]
    assert np.allclose([got[i] for i in known], brute_bh(np.array([p[i] for i in known])))
    assert got[4] is None and got[5] is None
    assert {r.i: r.q_value for r in bh.adjust_global(rows).collect()} == pytest.approx(got, nan_ok=True) or all((got[i] is None) == (v is None) for i, v in ((r.i, r.q_value) for r in bh.adjust_global(rows).collect()))


def test_bh_global_equals_window(spark):
    p = np.random.default_rng(3).random(3000).round(3)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p_value double").repartition(7)
    got = {r.i: r.q_value for r in bh.adjust_global(rows).collect()}
    assert np.allclose([got[i] for i in range(len(p))], brute_bh(p))
    assert bh.adjust_global(rows.filter("false")).count() == 0


def test_pairs_with_bad_values(spark):
    rows = spark.createDataFrame([("a", "x", 0, 1.0), ("a", "x", 1, 2.0), ("b", "x", 0, 0.0), ("b", "x", 1, 2.0), ("c", "x", 0, -1.0), ("d", "x", 1, 4.0), ("e", "x", 0, None), ("e", "x", 1, 1.0)], "who string, f string, t int, v double")
    changes = paired.with_change(paired.pairs(rows, ["f"], "who", F.col("t") == 0, F.col("t") == 1, "v"))
    e = paired.effects(changes, ["f"]).first()
    assert e.n_pairs == 1 and e.mean_log2fc == 1.0 and e.p_value == 1.0
    assert paired.effects(changes, ["f"], min_pairs=3).count() == 0


def test_selection_precedence(spark):
    rows = spark.createDataFrame([(0.01, 2.0), (0.01, -2.0), (0.01, 0.1), (0.9, 2.0), (None, 1.0), (0.01, None)], "q double, e double")
    got = [r.s for r in rows.select(paired.selection(F.col("q"), F.col("e"), 0.05, 1.0).alias("s")).collect()]
    assert got == ["higher", "lower", "significant_below_threshold", "not_selected", "not_testable", "not_testable"]


def test_left_unique_refuses_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ConstraintError):
        relational.left_unique(left, right, ["k"])
    enforce(duplicates(left, "k"), "fine")


def test_one_to_many_keeps_rows_without_match(spark):
    out = relational.one_to_many(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, v string"), "k", ["o"], "xs")
    assert {r.k: [x.v for x in r.xs] for r in out.collect()} == {1: ["a", "b"], 2: []}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1050)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_entities_merge_transitively_and_prefer_articles(spark):
    schema = "id int, doi string, pmid string, pmcid string, linked_published_doi string, title string, publication_year string, journal string, abstract string, source_system string, is_preprint boolean, cited_by_count string, publication_types string"
    rows = [
        (1, "10.1/A", None, None, None, "T", "2020", "J", "short", "x", False, None, "journal-article"), (2, None, "5", None, "10.1/a", "T pre", "2019", "J", "much longer abstract", "y", True, "7", "preprint"),
        (3, None, "5", "pmc9", None, "T", "2020", "J", "", "z", False, None, ""), (4, None, None, None, None, "Alone!", "2001", None, None, "x", None, None, None),
    ]
    assigned = entities.assign(spark.createDataFrame(rows, schema))
    groups = {r.id: r.entity for r in assigned.collect()}
    assert groups[1] == groups[2] == groups[3] == "doi:10.1/a" and groups[4] == "title:alone|2001"
    merged = {r.entity: r for r in entities.merge(assigned).collect()}
    one = merged["doi:10.1/a"]
    assert one.member_count == 3 and one.title == "T" and one.cited_by_count == "7" and not one.is_preprint and one.has_preprint_version and "title:" in one.conflicts and "publication_year:" in one.conflicts


def test_screen_keeps_unknown_apart_from_no(spark):
    schema = "k int, title string, abstract string, journal string, notes string, publication_types string, is_preprint boolean, linked_published_doi string, has_conflicts boolean"
    rows = [(1, "A thing", None, "", "", "journal-article", False, None, False), (2, "Exercise in humans", "Human exercise", "", "", "journal-article", False, None, False), (3, "Mice run", "mice", "", "", "journal-article", False, None, False), (4, "X", "polymer Lac-Phe", "", "", "journal-article", False, None, True)]
    got = {r.k: r for r in screening.screen(spark.createDataFrame(rows, schema), ("LacPhe",)).collect()}
    assert got[1].screen_class == "screening_uncertain_insufficient_text" and got[1].human_evidence == "unknown:no_abstract_text"
    assert got[2].screen_class == "direct_human_exercise" and got[3].screen_class == "animal_or_invitro_mechanistic"
    assert got[4].homonym_risk == "flagged_non_metabolite_homonym_context" and got[4].review_status == "requires_human_review"


def test_crosswalk_rules(spark):
    cards = spark.createDataFrame([("VO2peak", "fitness", "mL/kg/min", "cpet", "baseline"), ("stage", "stage", "x", "cpet", "b"), ("wrist_steps_14d", "w", "steps/day", "actigraphy", "b"), ("fasting_glucose", "g", "mmol/L", "clinical", "b"), (None, None, None, None, None)], "source_variable string, label string, unit string, modality string, timing string")
    got = {r.source_variable: r for r in catalog.review_reason(catalog.crosswalk(cards)).collect()}
    assert got["VO2peak"].confidence == 0.78 and got["VO2peak"].review_status == "requires_human_review" and got["VO2peak"].review_reason == "confirm_exercise_protocol"
    assert got["stage"].common_variable == "not_mapped" and got["wrist_steps_14d"].common_variable == "steps_per_day"
    assert got["fasting_glucose"].transform == "multiply_by_18.0182" and got["fasting_glucose"].review_status == "accepted"
    assert got[None].review_status == "rejected"


def test_quality_scope(spark):
    schema = "human boolean, modalities array<string>, sample_size int, has_metadata boolean, has_codebook boolean, has_data_files boolean, assay_platform string, sample_matrix string, biospecimen_timing string"
    got = [r.overall_score for r in catalog.quality(spark.createDataFrame([(False, ["metabolomics"], 5, True, True, True, "a", "b", "c"), (None, None, None, None, None, None, None, None, None)], schema)).collect()]
    assert got[0] is None and got[1] is not None


def test_auroc_counts_pairs_and_half_ties(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 120), rng.integers(0, 9, 120) / 10
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    got = evaluate.auroc(spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, s)], "y boolean, s double"), F.col("y"), "s").first()
    assert got.auroc == pytest.approx(np.mean(pairs))
    assert evaluate.auroc(spark.createDataFrame([(True, 1.0)], "y boolean, s double"), F.col("y"), "s").first().auroc is None


def test_rates_over_nothing_are_unknown(spark):
    c = evaluate.confusion(spark.createDataFrame([(True, True), (True, None)], "a boolean, p boolean"), F.col("a"), F.col("p")).first()
    assert c.sensitivity == 1.0 and c.specificity is None and c.abstained == 1


def test_grid_has_every_cell(spark):
    cells = spark.createDataFrame([("f1", "c1", 1.0, "accepted", "f1", 0.0, 0.0), ("f2", "c2", 2.0, "proposed", "f2", 0.0, 0.0), ("f2", "c1", None, "accepted", "f2", 0.0, 0.0)], "f string, c string, e double, mapping_status string, canonical_feature_id string, missing_fraction double, below_lod_fraction double")
    got = {(r.f, r.c): (r.cell_status, r.value) for r in views.heatmap(cells, "f", "c", "e", True).collect()}
    assert got == {("f1", "c1"): ("observed", 1.0), ("f1", "c2"): ("not_reported", None), ("f2", "c1"): ("effect_not_reported", None), ("f2", "c2"): ("unreviewed_harmonization", None)}


def test_filter_stays_above_the_window(spark):
    rows = spark.createDataFrame([("s", f"l{i % 3}", i / 10, 1.0, f"n{i}") for i in range(9)], "s string, l string, p double, e double, n string")
    e = views.enrichment(rows, "s", "l", F.col("p") < 0.35, "e", "p", "n").filter("l = 'l1'")
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter (l#") < plan.index("Window") if "Filter (l#" in plan else "Window" in plan
    assert e.count() == 1


def test_text_functions(spark):
    row = spark.range(1).select(
        X.norm_name(F.lit(" Peak VO₂ (max) ")).alias("name"), X.norm_metabolite(F.lit("α-Ketoglutarate")).alias("met"), X.norm_metabolite(F.lit("ab")).alias("short"), X.norm_unit(F.lit("µmol per Litre")).alias("unit"),
        X.norm_identifier(F.lit("ChEBI ID"), F.lit(" 123 ")).alias("chebi"), X.compound_identifier(F.lit("hmdb123")).alias("hmdb"), X.html_text(F.lit("a &lt;b&gt;x&lt;/b&gt; &amp; c")).alias("html"), X.class_norm(F.lit("Fatty Acids")).alias("cls"),
        X.redact_url(F.lit("u?api_key=1&z=2&email=q")).alias("url"), X.adduct_core(F.lit("[M+Cl]-")).alias("ad1"), X.adduct_core(F.lit("M.Cl")).alias("ad2"), X.name_in_text(F.lit("Lac-Phe"), F.lit("about lacphe")).alias("has"),
        X.token_sequence_in(F.lit("wrist_steps_14d"), F.lit("steps")).alias("tok"), X.token_sequence_in(F.lit("stage"), F.lit("age")).alias("notok"), C.factor_map(F.lit("A: 1 | b:2 |x| a: 3:4")).alias("m"), C.parse_float(F.lit("nan")).alias("nan"), C.parse_int(F.lit("12.0")).alias("i"), C.year_of(F.lit("2021 Spring")).alias("y"),
        X.echo_status(F.lit("A"), F.lit(None).cast("string")).alias("echo"),
    ).first()
    assert (row["name"], row.met, row.short, row.unit, row.chebi, row.hmdb) == ("peak_vo2_max", "alphaketoglutarate", "", "umol/l", "CHEBI:123", "HMDB0000123")
    assert row.html == "a x & c" and row.cls == "fattyacid" and row.url == "u?api_key=%3Credacted%3E&z=2&email=%3Credacted%3E" and row.ad1 == row.ad2 == "M+CL"
    assert row.has and row.tok and not row.notok and row.m == {"a": "3:4", "b": "2"} and row.nan is None and row.i == 12 and row.y == 2021 and row.echo == "no_echo"


def test_entities_that_are_cut_off_stay(spark):
    cases = {"a &amp": "a &amp", "b &quot": "b &quot", "&ampfoo; c": "&ampfoo; c", "d &copy; &#39;e&#x27; &amp;lt;i&amp;gt;": "d © 'e' <i>"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.html_text(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


def test_assay_pair_with_itself_raises(spark):
    records = spark.createDataFrame([], assay.FIELDS)
    with pytest.raises(ConstraintError):
        assay.decide(spark.createDataFrame([("a", "a")], "left_id string, right_id string"), records)


def test_ledger_keeps_unmapped_hops(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = ledger.inference_ledger(df([("g", "r")], "gene string, reaction string"), df([("r", "c1"), ("r", "c2")], "reaction string, compound string"), df([("c1", "n")], "compound string, name string"), df([("n", "s")], "name string, study string")).collect()
    assert any(r.state == "absent_no_refmet_mapping" and r.subject == "c2" for r in got) and not any(r.is_evidence_of_absence for r in got)
    assert any(r.hop == "gene_to_study" and r.object == "s" for r in got)


def test_aliases_and_packets(spark):
    names = spark.createDataFrame([("old",), ("new",)], "name string")
    aliases = spark.createDataFrame([("old", "new", "1.10.0", "1.9.0")], "alias string, target string, current string, removed_in string")
    assert {r.name: (r.resolved, r.deprecated, r.removed) for r in ledger.resolve_aliases(names, aliases).collect()} == {"old": ("new", True, True), "new": ("new", False, False)}
    packets = spark.createDataFrame([(1, '{"a":{"confidence":1}}'), (2, "oops"), (3, '{"t":"fine"}')], "k int, body string")
    assert {(r.k, r.violation) for r in ledger.packet_violations(packets, "k", "body").collect()} == {(1, "field:confidence"), (2, "not_json")}


def test_typed_loads_stop_on_bad_rows(spark):
    from veridex.operators import intake

    df = lambda rows, s: spark.createDataFrame(rows, s)
    flags = ", ".join(f"{f} string" for f in ("human", *intake.MODALITY_FLAGS))
    good = df([("s1", "", *["true"] * 8)], f"study_id string, doi string, {flags}")
    assert intake.publications(good, strict=True).first().doi == "not_reported"
    with pytest.raises(ConstraintError):
        intake.publications(df([("s1", "", "yes", *["true"] * 7)], f"study_id string, doi string, {flags}"), strict=True)
    with pytest.raises(ConstraintError):
        intake.publications(good.unionByName(good))
    with pytest.raises(ConstraintError):
        intake.mappings(df([("s", "v", "not_mapped", "accepted")], "source_study string, source_variable string, common_variable string, review_status string"))
    with pytest.raises(ConstraintError):
        intake.quality_scores(df([("s", None, None)], "study_id string, overall_score string, scope_status string"))
    assert intake.quality_scores(df([("s", None, "out_of_scope_non_human")], "study_id string, overall_score string, scope_status string")).count() == 1
    rows = df([("a", "c", "n", "1"), ("b", "c", "n", "2"), ("d", "c", "p", "3"), ("e", "c", "p", None)], "sample_id string, cohort_id string, y string, f string")
    assert intake.model_rows(rows, ["f"], "y", ("n", "p"), complete=False).count() == 4
    with pytest.raises(ConstraintError):
        intake.model_rows(rows, ["f"], "y", ("n", "p"), complete=True)
    with pytest.raises(ConstraintError):
        intake.both_or_none(a=1, b=None)
    with pytest.raises(ConstraintError):
        intake.resolve("moon", intake.SCOPES, "scope")
    assert intake.synthetic_cohort(spark, 4, 2).count() == 8
    assert [r.a for r in df([("Open",), ("restricted",), ("odd",), (None,)], "x string").select(intake.availability(F.col("x")).alias("a")).collect()] == ["public", "restricted_metadata_only", None, "unknown"]

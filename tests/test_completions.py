"""Labels, overlaps, views, strata, literature figures and costs on rows that the given tables don't have."""

import pytest
from pyspark.sql import functions as F

from veridex.functions import kernels
from veridex.operators import intake, linalg, paired, relational, screening, views
from veridex.operators.constraints import ConstraintError
from veridex.sources import files


def test_labels_that_pairs_share(spark):
    rows = [("a", 1.0, 2.0, "x", None), ("a", 1.0, 4.0, " x ", "f"), ("a", None, 4.0, "y", "m"), ("b", 1.0, 2.0, "", "f"), ("b", 2.0, 2.0, "x", "m")]
    df = paired.with_change(spark.createDataFrame(rows, "k string, before double, after double, grp string, sex string"))
    got = {r.k: (r.n_pairs, r.grp, r.sex) for r in paired.effects(df, ["k"], labels=("grp", "sex")).collect()}
    assert got == {"a": (2, "x", "f"), "b": (2, "x", "")}


def test_overlap_names_what_is_left_out(spark):
    left = spark.createDataFrame([("l", k) for k in ["a", "b", "b", "c", "d", "", "z"]], "contrast string, k string")
    right = spark.createDataFrame([("r", k) for k in ["a", "b", "c", "c", "d", ""]] + [("few", "a")], "contrast string, k string")
    found = [tuple(r[c] for c in ("left_contrast", "right_contrast", "n_overlap", "excluded_overlap", "excluded_keys", "left_ambiguous", "right_ambiguous")) for r in paired.overlap_report(left, right, "contrast", "contrast", "k", 2).collect()]
    assert found == [("l", "r", 2, 2, "b;c", 1, 1)]


def test_a_broken_interval_stops_the_view(spark):
    schema = "feature_id string, canonical_feature_id string, contrast_id string, ci_low double, ci_high double, ci_semantics string"
    contrasts = spark.createDataFrame([("c1", 2), ("c2", 1)], "contrast_id string, display_order int")
    good = [("f", None, "c1", 0.0, 1.0, "95"), ("g", "f", "c2", None, None, " "), ("h", "other", "c1", 2.0, 1.0, None)]
    view = views.single_feature(spark.createDataFrame(good, schema), contrasts, "f").orderBy("contrast_order").collect()
    assert [(r.feature_id, r.ci_semantics) for r in view] == [("g", views.NO_INTERVAL), ("f", "95")]
    for bad in (("f", "", "c1", 1.0, None, None), ("f", "", "c1", 2.0, 1.0, None)):
        with pytest.raises(ConstraintError):
            views.single_feature(spark.createDataFrame([*good, bad], schema), contrasts, "f")


def test_rows_of_one_contrast_and_feature_have_one_order(spark):
    schema = "feature_id string, canonical_feature_id string, contrast_id string, effect double, ci_low double, ci_high double, ci_semantics string"
    contrasts = spark.createDataFrame([("c1", 1)], "contrast_id string, display_order int")
    rows = [("f", None, "c1", e / 10, low, None if low is None else 9.0, said) for e in range(4) for low, said in ((None, "a"), (None, "b"), (1.0, None), (2.0, "a"))]
    views_ = [views.single_feature(spark.createDataFrame(given, schema), contrasts, "f") for given in (rows, rows[::-1])]
    first, second = (sorted((r.contrast_order, r.effect, str(r.ci_low), r.ci_semantics) for r in v.collect()) for v in views_)
    assert first == second and [r[0] for r in first] == list(range(1, 17)) and [r[1] for r in first] == sorted((r[1] for r in first), reverse=True)


def test_strata(spark):
    row = spark.createDataFrame([("w  x", None, " ")], "a string, b string, c string")
    assert row.select(views.stratum_value({"source_system": F.col("a"), "study_id": F.col("b"), "species": F.col("c")}).alias("s")).first().s == "source_system=w x | study_id=not_reported | species=not_reported | sample_matrix=not_reported | assay_panel=not_reported | accession_or_contrast=not_reported | sex_or_subgroup=not_reported"
    rows = spark.createDataFrame([("s", "a", None), ("s", "a", None), ("t", "a", "x"), ("t", "b", "x")], "s string, p string, q string")
    assert {(r.s, r.column, r["values"]) for r in views.mixed_strata(rows, "s", ["p", "q"]).collect()} == {("s", "q", 0), ("t", "p", 2)}


def test_literature_figures(spark):
    schema = "doc_id int, title string, abstract string, journal string, notes string, publication_types string, is_preprint boolean, linked_published_doi string, has_conflicts boolean, publication_year string"
    human = "healthy volunteers took part in a randomized controlled trial of treadmill exercise; Lac-Phe was measured in plasma. ST003662"
    rows = [(1, "Lac-Phe", human, "j", "", "journal-article", False, None, False, "2021"), (2, "Lac-Phe", human, "j", "", "journal-article", True, None, True, "2021"), (3, "Nothing", "of mice", "j", "", "journal-article", False, None, False, ""), (4, "Nothing", "", "j", "", "retraction", False, None, False, None)]
    found = {(r.metric, r.value): r.n for r in screening.literature_stats(screening.screen(spark.createDataFrame(rows, schema), ("Lac-Phe",)), "doc_id").collect()}
    assert found["record_count", None] == 4 and found["confirmed_count", None] == 2 and found["year", "2021"] == 2 and ("year", "") not in found
    assert found["human_exercise_count", None] == 2 and found["human_exercise_primary_count", None] == 1 and found["replication_count", None] == 1 and found["human_exercise_with_accession", None] == 2
    assert found["subject_absent", None] == 1 and found["no_abstract", None] == 1 and found["retracted_count", None] == 1 and found["preprint_count", None] == 1
    assert found["escalation", "cross_source_metadata_conflict"] == 1 and found["escalation_total", None] == sum(n for (m, _), n in found.items() if m == "escalation")


def test_costs(spark):
    rows = spark.createDataFrame([(10**9, "MAX_PERMUTATION_WORK_UNITS"), (300, "MAX_SAMPLES_EIGEN"), (301, "MAX_SAMPLES_EIGEN"), (-1, "MAX_SAMPLES_EIGEN"), (1, "none")], "n bigint, cap string")
    got = [(r.estimated_seconds, r.within_cap) for r in linalg.cost_estimates(rows, "n", "cap").collect()]
    assert got == [(200.0, True), (6e-05, True), (6.02e-05, False), (None, None), (2e-07, None)]


def test_lower_gamma_keeps_small_values():
    assert kernels.gammainc_p(5.0, 1e-3) == pytest.approx(1e-15 / 120 * (1 - 5e-3 / 6), rel=1e-5)
    assert kernels.gammainc_p(2.5, 7.0) + kernels.gammainc_q(2.5, 7.0) == pytest.approx(1.0)


def test_value_counts_and_grids(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "x string, y int")
    assert {(r.field, r.value, r.n) for r in relational.value_counts(df, ["x", "y"]).collect()} == {("x", "a", 2), ("x", "b", 1), ("y", "1", 2), ("y", None, 1)}
    wide = spark.range(relational.GRID_COLUMNS + 1).select(F.col("id").alias("y"))
    with pytest.raises(ConstraintError):
        relational.complete_grid(df, df.select("x"), wide)


def test_quoted_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"one, two",b\n"x, y",2\n')
    rows = files.scan_csv_strict(spark, f"file://{tmp_path}/a.csv", ("one, two", "b"), exact=True).collect()
    assert [tuple(r) for r in rows] == [("x, y", "2")]


def test_unknown_aliases_are_null(spark):
    got = [r.s for r in spark.createDataFrame([("Blood",), ("nowhere",), (None,)], "a string").select(intake.resolved(F.col("a"), intake.SCOPES).alias("s")).collect()]
    assert got == ["blood_plasma", None, None]


def test_letters_and_blanks_beyond_ascii(spark):
    from veridex.functions import text
    from veridex.operators import ledger

    row = spark.createDataFrame([(" CHEBI:12 ", "a  　b", "maſs index", "ＳＴ")], "a string, b string, c string, d string")
    got = row.select(text.namespace(F.col("a")).alias("a"), text.norm_space(F.col("b")).alias("b"), text.norm_unit(F.lit("mg / dL")).alias("u")).first()
    assert (got.a, got.b, got.u) == ("chebi", "a b", "mg/dl")
    packets = spark.createDataFrame([(1, '{"detail": "the ACCEPTED candidate; reject this Study"}'), (2, '{"detail": "Étude réussie"}')], "id int, body string")
    assert {r.id for r in ledger.packet_violations(packets, "id", "body").collect()} == {1}


def test_flags_of_studies_go_by_whole_words(spark):
    row = spark.createDataFrame([("a dietary study of humans", "cross-training", None)], "a string, b string, c string")
    flags = row.select(*[c.alias(n) for n, c in screening.publication_flags(F.col("a"), F.col("b"), F.col("c")).items()]).first().asDict()
    assert flags == {"human": False, "exercise": True, "actigraphy": False, "genetics": False, "cpet": False, "body_composition": False, "diet": False, "metabolomics": True}

"""Digests that merge, versions that are whole or refused, and differences of versions."""

import pytest
from pyspark.sql import functions as F

from veridex.operators import corpus
from veridex.operators.constraints import ConstraintError
from veridex.sources import snapshots

ROWS = [(1, "a", 0.5), (2, None, None), (2, "", 1.0), (3, "a;b:c", -1.0), (3, "a;b:c", -1.0)]
SCHEMA = "k int, `odd name` string, x double"


def digest(df):
    return snapshots.multiset_digest(df).select(snapshots.sealed().alias("d")).first().d


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_digests_tell_rows_and_their_number(spark, df):
    same = spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(4).select("x", "k", "odd name")
    assert digest(df) == digest(same)
    others = [ROWS[:-1], [(1, "a", 0.5), (2, "", None), *ROWS[2:]], [(1, None, 0.5), *ROWS[1:]], [*ROWS, ROWS[0]], []]
    found = {digest(spark.createDataFrame(r, SCHEMA)) for r in others} | {digest(df)}
    assert len(found) == len(others) + 1
    a, b = spark.createDataFrame([("1", "2:;b:1:x")], "a string, b string"), spark.createDataFrame([("1;b:4:2:;b", "x")], "a string, b string")
    assert digest(a) != digest(b)


def test_digests_merge(df):
    parts = snapshots.multiset_digest(df.withColumn("part", F.spark_partition_id() % 2).drop("part").withColumn("g", F.col("k") % 2), ["g"])
    whole = snapshots.multiset_digest(df.withColumn("g", F.col("k") % 2))
    assert snapshots.merged(parts).collect() == whole.collect()
    assert digest(df.limit(0)) == snapshots.merged(snapshots.multiset_digest(df.limit(0), ["k"])).select(snapshots.sealed().alias("d")).first().d


def test_a_version_is_whole_or_refused(spark, df, tmp_path):
    root = f"file://{tmp_path}"
    good = df.dropDuplicates(["k"]).select("k", "x")
    (tmp_path / "v1" / "rows").mkdir(parents=True)
    (tmp_path / "v1" / "rows" / "left-over.parquet").write_text("half")
    with pytest.raises(ConstraintError, match="not committed"):
        snapshots.read_version(spark, root, "v1")
    snapshots.commit(spark, root, "v1", {"rows": good}, {"rows": ["k"]})
    assert sorted(r.k for r in snapshots.read_version(spark, root, "v1")["rows"].collect()) == [1, 2, 3]
    with pytest.raises(ConstraintError, match="is committed"):
        snapshots.commit(spark, root, "v1", {"rows": good}, {})
    snapshots.commit(spark, root, "v2", {"rows": df, "few": df.filter("k = 1")}, {"rows": ["k"], "few": ["k", "odd name"]}, universe="k")
    failed = {(r.table, r.check): r.detail for r in snapshots.check(spark, root, "v2").filter("not ok").collect()}
    assert failed == {("rows", "repeated_key"): "2", (None, "universe"): "2"}
    with pytest.raises(ConstraintError, match="repeated_key"):
        snapshots.read_version(spark, root, "v2")
    snapshots._put(spark, f"{root}/v1/manifest.json", "{}")
    with pytest.raises(ConstraintError, match="not the one"):
        snapshots.read_version(spark, root, "v1")


def test_differences(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, ""), (5, "e")], "k int, v string")
    assert {(r.k, r.state) for r in snapshots.difference(old, new, ["k"]).collect()} == {(2, "changed"), (3, "changed"), (4, "gone"), (5, "added")}
    assert snapshots.difference(old, old, ["k"]).count() == 0


def test_first_rows_keep_blank_ones(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), (None, 4), (" ", 5), ("b", 6)], "id string, position int")
    assert sorted(("-" if r.id is None else r.id, r.position) for r in corpus.first_rows(rows, ["id"]).collect()) == [("", 3), (" ", 5), ("-", 4), ("a", 1), ("b", 6)]


def test_scopes_of_odd_texts(spark):
    analyses = spark.createDataFrame([("1", "s", "Non-Targeted", None, None), ("2", "s", "untargetedly", None, ""), ("3", "s", None, None, None), ("4", "s", "a TARGETED panel", "x", "y"), (" 5 ", "s", "targeted", None, None)], "analysis_id string, study_id string, analysis_summary string, analysis_display string, analysis_type string")
    found = {r.analysis_id.strip(): (r.assay_scope, r.assay_scope_basis) for r in corpus.classified(analyses, spark.createDataFrame([("5",), (None,), ("",)], "analysis_id string")).collect()}
    assert found["1"] == ("explicit_untargeted", corpus.BY_TEXT) and found["2"][0] == found["3"][0] == "unclassified_or_other"
    assert found["4"] == ("explicit_targeted", corpus.LOWER_BOUND) and found["5"] == ("explicit_untargeted", corpus.BY_INDEX)

"""Strict inputs fail before anything is written; outputs appear whole or not at all."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veridex.operators.constraints import ConstraintError
from veridex.sources import files, responses
from veridex.streaming import incremental


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv_lenient_and_strict(spark, tmp_path):
    good = put(tmp_path / "a.csv", 'k,v\n1,"x, y"\n2,\n')
    assert [tuple(r) for r in files.scan_csv(spark, good).collect()] == [("1", "x, y"), ("2", "")]
    assert files.scan_csv_strict(spark, good, ("k",)).count() == 2
    for text in ("k,k\n1,2\n", "k,\n1,2\n", "v\n1\n", "k,v\n", "k,v\n1,2,3\n"):
        with pytest.raises(ConstraintError):
            files.scan_csv_strict(spark, put(tmp_path / "b.csv", text), ("k",))


def test_da_table_and_folder(spark, tmp_path):
    table = "feature_id\tlogFC\tp_value\tadj_p_value\tcontrast\nf1\t1.5\t0\t0.1\tEE pre\n\t1\t0.1\t0.1\tpre\nf2\tnan\t0.1\t0.1\tpre\nf3\t1\t0.2\t0.3\tother\n"
    put(tmp_path / "plasma_lipid_targeted.txt", table)
    got = files.scan_da_table(spark, str(tmp_path / "plasma_lipid_targeted.txt")).collect()
    assert len(got) == 1 and got[0].feature_id == "f1" and got[0].p_value == 1e-300
    row = files.scan_folder(spark, str(tmp_path), r"^([a-z]+)_([a-z]+)_", ("tissue", "assay")).first()
    assert (row.tissue, row.assay) == ("plasma", "lipid")


def test_strict_json():
    assert files.parse_json_strict('{"a": 1}') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ConstraintError):
            files.parse_json_strict(bad)
    assert files.digest({"x": [{"id": 2}, {"id": 1}]}) == files.digest({"x": [{"id": 1}, {"id": 2}]})
    assert files.digest({"x": [2, 1]}) != files.digest({"x": [1, 2]})


def bundle(folder, rows="study_id,v\ns1,1\n", sha=None, path="t.csv", count=1):
    folder.mkdir(exist_ok=True)
    (folder / "t.csv").write_text(rows)
    (folder / "manifest.json").write_text(json.dumps({"files": {"t": {"path": path, "row_count": count, "sha256": sha or hashlib.sha256(rows.encode()).hexdigest()}}}))
    return str(folder)


def test_bundle_checks(spark, tmp_path):
    assert files.load_bundle(spark, bundle(tmp_path / "ok"), {"t": ["study_id"]})["t"].count() == 1
    for n, options in enumerate(({"sha": "0" * 64}, {"path": "../t.csv"}, {"count": 2}, {"rows": "study_id,v\ns1,1\ns1,2\n", "count": 2})):
        with pytest.raises(ConstraintError):
            files.load_bundle(spark, bundle(tmp_path / f"bad{n}", **options), {"t": ["study_id"]})


def test_publish_is_atomic_and_digest_is_order_free(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "k int, v string, l array<int>")
    manifest = files.publish(spark, str(tmp_path / "out"), {"t": df})
    assert manifest["t"]["row_count"] == 2 and files.table_digest(df.repartition(3)) == files.table_digest(df.orderBy(F.desc("k")))
    assert spark.read.parquet(str(tmp_path / "out" / "t")).count() == 2
    with pytest.raises(ConstraintError):
        files.publish(spark, str(tmp_path / "out"), {"t": df})
    files.write_csv(df, str(tmp_path / "csv"), ("v",), ("k",))
    assert files.scan_csv(spark, str(tmp_path / "csv")).columns == ["v", "k", "l"]
    assert files.markdown_table(spark.createDataFrame([("a|b",)], "x string")).endswith("| a/b |\n")


def test_aliases_must_agree(spark):
    value, bad = files.agreeing(spark.createDataFrame([("a", ""), ("a", "b")], "x string, y string"), "x", "y")
    assert bad.count() == 1
    with pytest.raises(ConstraintError):
        files.agreeing(spark.range(1).toDF("z"), "x")


def test_responses_are_classified(spark):
    rows = [(200, "application/json", "[1]"), (200, "application/json", "[]"), (404, "", ""), (503, "", ""), (200, "text/html", "<html>"), (None, None, None)]
    df = spark.createDataFrame(rows, "s int, c string, b string")
    assert [r.x for r in df.select(responses.classify(F.col("s"), F.col("c"), F.col("b")).alias("x")).collect()] == ["no_hits", "no_hits", "unavailable", "unavailable", "request_rejected", "unavailable"]
    gene = spark.createDataFrame([(500, "", ""), (200, "", ""), (200, "", "[]"), (200, "", "<b>warn</b>[1]"), (200, "", '[{"a":1}]')], "s int, c string, b string")
    assert [r.x for r in gene.select(responses.classify_gene(F.col("s"), F.col("b")).alias("x")).collect()] == ["gene_unresolved_or_source_error", "indeterminate_empty_body", "no_hits", "unavailable", "ok"]


def test_preprint_links_leave_other_rows(spark):
    records = spark.createDataFrame([("10.1/A", True, "10.9/old", "bio"), ("10.1/b", True, "10.9/own", "med"), ("10.1/c", False, None, None)], "doi string, is_preprint boolean, linked_published_doi string, preprint_server string")
    links = spark.createDataFrame([("10.1/a", "10.2/new", "rxiv"), ("10.1/c", None, "rxiv")], "doi string, published_doi string, server string")
    got = {r.doi: (r.is_preprint, r.linked_published_doi, r.preprint_server) for r in responses.link_preprints(records, links).collect()}
    assert got == {"10.1/A": (True, "10.2/new", "rxiv"), "10.1/b": (True, "10.9/own", "med"), "10.1/c": (True, None, "rxiv")}
    bare = responses.link_preprints(records.select("doi"), links).collect()
    assert {r.doi: r.is_preprint for r in bare} == {"10.1/A": True, "10.1/b": False, "10.1/c": True}


def test_json_shapes(spark):
    bodies = ['{"a": 1}', '{"Row1": {"a": 1}, "Row2": {"a": 2}}', '{"1": {"a": 5}}', '[{"a": 7}]', "{}"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert [[x.a for x in r.x] for r in df.select(responses.unwrap_rows(F.col("b"), "a int").alias("x")).collect()] == [[1], [1, 2], [5], [7], []]


def test_mass_table_repairs_a_missing_tab(spark):
    text = "target\tmatched\tdelta\tname\n100.0\t100.01\t0.01\tok\n100.0\t100.020.02\tglued\n"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(responses.mass_rows(F.col("t"))).alias("r")).select("r.*").collect()
    assert [(r.matched, r.delta) for r in got] == [(100.01, 0.01), (100.02, 0.02)]


def test_failed_pages_truncate(spark):
    pages = spark.createDataFrame([("a", "ok", 5, 10), ("a", "unavailable", 0, None), ("b", "ok", 3, 3), ("c", "unavailable", 0, None)], "source_system string, status string, rows int, reported_hits int")
    assert {r.source_system: r.state for r in responses.retrieval_state(pages).collect()} == {"a": "truncated", "b": "complete", "c": "unavailable"}
    assert responses.phrase_query(["a b", "c"], ["x"]) == '("a b" OR "c") AND "x"'


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.tumbling(incremental.read_events(spark, str(tmp_path / "in"), events.schema, 1), late="400 days")
    name = "tumbling_test"
    job = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    key = lambda r: (str(r.start), r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table(name).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).collect())) == sorted(map(key, incremental.tumbling(events).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).collect()))

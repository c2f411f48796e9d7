"""Declared constraints, VARIANT projections and sketches that merge."""

import json

import pytest
from pyspark.sql import functions as F

from veridex.functions import variants
from veridex.operators import contracts, estimates
from veridex.operators.constraints import ConstraintError


def declare(spark, *rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], contracts.DECLARATION)


def test_reasons(spark):
    t = spark.createDataFrame([("a", 1, "Some  Words\nhere"), ("a", 2, None), ("b", 1, ""), ("c", None, "x"), ("c", None, "x")], "k string, n int, body string")
    rows = [
        ("t", {"k": "a", "n": "1"}, {"body": "Some  Words\nhere"}, "body", ["words HERE", "not there"]),
        ("t", {"n": "2", "k": "a"}, {"body": None, "n": "2"}, "body", ["anything"]),
        ("t", {"k": "a"}, {"n": "1"}, None, None),
        ("t", {"k": "b"}, {"n": "1", "z": "1"}, None, []),
        ("t", {"k": "B"}, {}, None, []),
        ("t", {"k": "c", "n": None}, {}, None, []),
        ("t", {}, {}, None, []),
        ("t", {"none": "1"}, {}, None, []),
        ("u", {"k": "a"}, {}, None, []),
        ("t", {"k": "b"}, {"n": "1"}, None, None),
    ]
    got = {int(r.declaration_id): (r.rows, r.passed, r.reasons) for r in contracts.cross_check(declare(spark, *rows), {"t": t}).collect()}
    assert [got[i][2] for i in range(10)] == ["phrase_missing:not there", "phrase_missing:anything", "several_rows", "field_missing:z", "no_row", "no_row", "no_key", "unknown_key_column", "unknown_target", ""]
    assert got[2][0] == 2 and got[9] == (1, True, "") and not got[0][1]


def test_no_declarations_and_too_many_shapes(spark):
    t = spark.createDataFrame([("a",)], "k string")
    assert contracts.cross_check(spark.createDataFrame([], contracts.DECLARATION), {"t": t}).count() == 0
    many = declare(spark, *[("t", {f"c{i}": "1"}, {}, None, []) for i in range(contracts.SHAPES + 1)])
    with pytest.raises(ConstraintError):
        contracts.cross_check(many, {"t": t})


def test_rows_whichever_way_they_are_wrapped(spark):
    cases = {
        '{"1": {"a": 1}, "2": {"a": 2}}': 2, '{"Row1": {"a": 1}}': 1, '{"a": 1}': 1, '[{"a": 1}, 3, {"a": 2}]': 2, '[[{"a": 1}], [{"a": 2}, {"a": 3}], []]': 3, "{}": 0, "[]": 0, "null": 0, "7": 0, '"text"': 0,
        '{"1": {"a": 1}, "note": "x"}': 1, '{"1": 5}': 1, "broken": 0, "": 0,
    }
    df = spark.createDataFrame([(b, n) for b, n in cases.items()], "b string, n int").withColumn("v", F.try_parse_json("b"))
    got = {r.b: r.k for r in df.select("b", F.size(variants.rows_of(F.col("v"))).alias("k")).collect()}
    assert got == cases
    kinds = {r.b: r.k for r in df.select("b", variants.kind_of(F.col("v")).alias("k")).collect()}
    assert kinds["{}"] == "object" and kinds["[]"] == "array" and kinds["null"] == "null" and kinds["7"] == "scalar" and kinds["broken"] is None


def test_projections_tell_absent_null_and_odd_values(spark):
    bodies = [{"a": {"b": 5}}, {"a": {"b": "12"}}, {"a": {"b": "many"}}, {"a": {"b": None}}, {"a": 3}, {"a": {"b": [1]}}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, b string").withColumn("v", F.try_parse_json("b"))
    got = [(r.x, r.s) for r in df.select("i", *[c.alias(n) for c, n in zip(variants.projected(F.col("v"), {"x": ("$.a.b", "bigint")}).values(), ("x", "s"))]).orderBy("i").collect()]
    assert got == [(5, "ok"), (12, "ok"), (None, "bad_type"), (None, "null"), (None, "absent"), (None, "bad_type")]


def test_a_scan_without_inference(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": "x", "b": []}\nbroken\n')
    assert [r.k for r in variants.scan_json_variant(spark, f"file://{tmp_path}/a.json").select(variants.kind_of(F.col("v")).alias("k")).collect()] == ["object", "object", None]


def test_sketches_merge_within_their_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("g"), (F.col("id") % 11).alias("h"), (F.col("id") * 37 % 20_011).alias("d"), F.when(F.col("id") % 5 > 0, F.pow(F.col("id") % 997, F.lit(2.0))).alias("x"))
    parts = estimates.partials(df, ["g", "h"], "d", "x").cache()
    for by in (["g"], ["h"], []):
        rows = estimates.checked(df, parts, by, "d", "x", 0.25).collect()
        assert all(r.distinct_within and r.quantile_within for r in rows) and sum(r.n for r in rows) == 60_000 and sum(r.known for r in rows) == 48_000
    whole = estimates.estimates(estimates.rolled_up(parts, []), [], 0.5).first()
    assert whole.distinct != 20_011 or whole.quantile is not None
    parts.unpersist()


def test_groups_without_numbers(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 1, float("nan")), ("c", 2, 4.0)], "g string, d int, x double")
    got = {r.g: (r.n, r.known, r.distinct, r.quantile) for r in estimates.estimates(estimates.partials(df, ["g"], "d", "x"), ["g"], 0.5).collect()}
    assert got == {"a": (1, 0, 0, None), "b": (1, 0, 1, None), "c": (1, 1, 1, 4.0)}

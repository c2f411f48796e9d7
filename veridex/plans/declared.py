"""Queries over declared constraints, VARIANT projections and mergeable estimates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants
from ..operators import contracts, estimates
from ..registry import query, table
from ..staging import discard, shared_dir, stage


@query("contract_crosscheck", """
WITH d AS (
 SELECT 'supplier-' || s_suppkey AS declaration_id, 'supplier' AS target, CASE WHEN s_suppkey % 10 = 3 THEN 'no_row' WHEN s_suppkey % 10 = 4 THEN 'field_missing:s_phone' WHEN s_suppkey % 10 = 5 THEN 'field_differs:s_name;field_differs:s_nationkey' WHEN s_suppkey % 10 = 6 THEN 'phrase_missing:of nowhere' ELSE '' END AS reasons, CASE WHEN s_suppkey % 10 = 3 THEN 0 ELSE 1 END AS rows FROM supplier
 UNION ALL SELECT 'nation-' || n_nationkey, 'nation', CASE WHEN n_nationkey % 5 = 1 THEN 'no_row' ELSE '' END, CASE WHEN n_nationkey % 5 = 1 THEN 0 ELSE 1 END FROM nation
 UNION ALL SELECT 'segment-' || c_custkey, 'customer', CASE WHEN n = 1 THEN '' ELSE 'several_rows' END, n FROM customer JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) USING (c_mktsegment)
 UNION ALL SELECT 'odd-' || r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'nothing' ELSE 'region' END, CASE r_regionkey % 3 WHEN 0 THEN 'unknown_target' WHEN 1 THEN 'unknown_key_column' ELSE 'no_key' END, 0 FROM region)
SELECT declaration_id, target, CAST(rows AS BIGINT) AS rows, reasons = '' AS passed, reasons FROM d""")
def contract_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration for each supplier, nation and customer, some of them wrong in different ways."""
    supplier, nation, customer, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "customer", "region"))
    s, text = F.col("s_suppkey"), lambda c: F.col(c).cast("string")
    strings = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    none, nothing = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    k = s % 10
    expected = F.when(k == 4, strings("s_phone", F.lit("1"))).when(k == 5, strings("s_name", F.concat("s_name", F.lit("x")), "s_nationkey", F.lit(None).cast("string"))).otherwise(strings("s_name", F.col("s_name"), "s_nationkey", text("s_nationkey")))
    made = supplier.select(F.concat(F.lit("supplier-"), s).alias("declaration_id"), F.lit("supplier").alias("target"), strings("s_suppkey", F.when(k == 3, F.concat(F.lit("x"), s)).otherwise(text("s_suppkey"))).alias("key"), expected.alias("expected"), F.lit("s_name").alias("phrase_field"), F.when(k == 6, F.array(F.lit("SUPPLIER"), F.lit("of nowhere"))).when(k == 7, F.array(F.lit("supplier#"))).otherwise(nothing).alias("phrases"))
    n = F.col("n_nationkey")
    made = made.unionByName(nation.select(F.concat(F.lit("nation-"), n).alias("declaration_id"), F.lit("nation").alias("target"), strings("n_name", F.col("n_name"), "n_regionkey", F.when(n % 5 == 1, F.lit("99")).otherwise(text("n_regionkey"))).alias("key"), strings("n_nationkey", text("n_nationkey")).alias("expected"), F.lit(None).cast("string").alias("phrase_field"), nothing.alias("phrases")))
    made = made.unionByName(customer.select(F.concat(F.lit("segment-"), F.col("c_custkey")).alias("declaration_id"), F.lit("customer").alias("target"), strings("c_mktsegment", F.col("c_mktsegment")).alias("key"), none.alias("expected"), F.lit(None).cast("string").alias("phrase_field"), nothing.alias("phrases")))
    r = F.col("r_regionkey")
    made = made.unionByName(region.select(F.concat(F.lit("odd-"), r).alias("declaration_id"), F.when(r % 3 == 0, "nothing").otherwise("region").alias("target"), F.when(r % 3 == 2, none).otherwise(strings("r_size", F.lit("1"))).alias("key"), none.alias("expected"), F.lit(None).cast("string").alias("phrase_field"), nothing.alias("phrases")))
    return contracts.cross_check(stage(made, "declarations"), {"supplier": supplier, "nation": nation, "customer": customer, "region": region})


@query("variant_rows", """
WITH r AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, unnest(CASE event_id % 8 WHEN 0 THEN [0] WHEN 1 THEN [0, 1] WHEN 2 THEN [0, 1] WHEN 3 THEN [0, 1, 2] WHEN 4 THEN [0] WHEN 5 THEN [0] WHEN 6 THEN [0] ELSE [] END) AS step FROM events)
SELECT event_id, CASE WHEN event_id % 8 IN (4, 5, 6) THEN NULL ELSE k + step END AS k, CASE event_id % 8 WHEN 4 THEN 'bad_type' WHEN 5 THEN 'null' WHEN 6 THEN 'absent' ELSE 'ok' END AS k_status, CASE event_id % 8 WHEN 6 THEN 'w' || k END AS deep, CASE event_id % 8 WHEN 6 THEN 'ok' ELSE 'absent' END AS deep_status FROM r""")
def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of eight shapes in one column: lists, lists in lists, numbered fields, single objects, odd types, broken text."""
    kind, k = F.col("event_id") % 8, F.get_json_object("props", "$.k").cast("bigint")
    one = lambda v: F.concat(F.lit('{"k": '), v, F.lit("}"))
    listed = lambda *xs: F.concat(F.lit("["), F.concat_ws(", ", *xs), F.lit("]"))
    body = (
        F.when(kind == 0, one(k)).when(kind == 1, F.concat(F.lit('{"Row1": '), one(k), F.lit(', "Row2": '), one(k + 1), F.lit("}"))).when(kind == 2, listed(one(k), F.lit("7"), one(k + 1)))
        .when(kind == 3, listed(listed(one(k), one(k + 1)), listed(one(F.concat(F.lit('"'), k + 2, F.lit('"'))))))
        .when(kind == 4, one(F.lit('"many"'))).when(kind == 5, one(F.lit("null"))).when(kind == 6, F.concat(F.lit('{"a": [{"b": "w'), k, F.lit('"}]}'))).otherwise(F.lit("{broken"))
    )
    folder = f"{shared_dir(spark)}/veridex/responses-{uuid.uuid4().hex}"
    discard(spark, folder)
    table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", body.alias("body"))).alias("value")).write.text(folder)
    outer = variants.scan_json_variant(spark, folder).select(F.try_variant_get("v", "$.event_id", "bigint").alias("event_id"), F.try_parse_json(F.try_variant_get("v", "$.body", "string")).alias("body"))
    rows = outer.select("event_id", F.explode(variants.rows_of(F.col("body"))).alias("r"))
    found = variants.projected(F.col("r"), {"k": ("$.k", "bigint"), "deep": ("$.a[0].b", "string")})
    return rows.select("event_id", *[c.alias(n) for n, c in found.items()])


@query("sketch_rollup", """
SELECT l_returnflag, count(*) AS n, count(l_extendedprice) AS known, CAST(sum(CAST(l_extendedprice AS DECIMAL(28, 6))) AS DECIMAL(38, 2)) AS total, count(DISTINCT l_partkey) AS exact_distinct, true AS distinct_within, true AS quantile_within FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'all', count(*), count(l_extendedprice), CAST(sum(CAST(l_extendedprice AS DECIMAL(28, 6))) AS DECIMAL(38, 2)), count(DISTINCT l_partkey), true, true FROM lineitem""")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by flag, status and year, rolled up to flags and to all rows, held against exact figures."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), "l_partkey", "l_extendedprice")
    parts = stage(estimates.partials(lines, ["l_returnflag", "l_linestatus", "year"], "l_partkey", "l_extendedprice"), "partials")
    by_flag = estimates.checked(lines, parts, ["l_returnflag"], "l_partkey", "l_extendedprice", 0.5)
    whole = estimates.checked(lines, parts, [], "l_partkey", "l_extendedprice", 0.9).withColumn("l_returnflag", F.lit("all"))
    return by_flag.unionByName(whole).select("l_returnflag", "n", "known", F.col("total").cast("decimal(38,2)").alias("total"), "exact_distinct", "distinct_within", "quantile_within")

"""Response-parsing queries: bodies are built from the driver's tables, so each shape and status occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.collections import year_of
from ..registry import query, table
from ..sources import responses


@query("unwrap_json_shapes", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + unnest(CASE event_id % 5 WHEN 0 THEN [0] WHEN 1 THEN [0, 1] WHEN 2 THEN [0, 1] WHEN 3 THEN [0] ELSE [] END) AS k FROM events""")
def unwrap_json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row, numbered rows, lists and empty objects as one table."""
    kind, n = F.col("event_id") % 5, F.get_json_object("props", "$.k").cast("bigint")
    one = lambda v: F.concat(F.lit('{"k": '), v, F.lit("}"))
    body = F.when(kind == 0, one(n)).when(kind == 1, F.concat(F.lit('{"Row1": '), one(n), F.lit(', "Row2": '), one(n + 1), F.lit("}"))).when(kind == 2, F.concat(F.lit("["), one(n), F.lit(", "), one(n + 1), F.lit("]"))).when(kind == 3, F.concat(F.lit('{"7": '), one(n), F.lit("}"))).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", F.explode(responses.unwrap_rows(body, "k bigint")).alias("r")).select("event_id", "r.k")


@query("explode_matrix", """
SELECT o_orderkey, 'S' || i AS sample, CASE WHEN i = 2 THEN NULL ELSE o_totalprice * i END AS value FROM orders, range(1, 4) t(i)""")
def explode_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metabolite-by-sample map as long rows; a value that is no number is NULL and stays."""
    p = F.col("o_totalprice")
    data = F.create_map(F.lit("S1"), p.cast("string"), F.lit("S2"), F.lit("below"), F.lit("S3"), (p * 3).cast("string"))
    return responses.explode_matrix(table(spark, sf_dir, "orders").withColumn("data", data), ["o_orderkey"], "data")


@query("retrieval_state", """
WITH s AS (SELECT user_id % 40 AS src, count(*) AS pages, count(*) FILTER (event_id % 4 = 0 AND user_id % 2 = 0) AS failed, count(*) FILTER (NOT (event_id % 4 = 0 AND user_id % 2 = 0)) AS retrieved FROM events GROUP BY ALL)
SELECT CAST(src AS VARCHAR) AS source_system, pages, failed, retrieved, CASE WHEN failed = pages THEN 'unavailable' WHEN failed > 0 THEN 'truncated' ELSE 'complete' END AS state FROM s""")
def retrieval_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged retrieval with completeness: failed pages make a source truncated, not final."""
    failed = (F.col("event_id") % 4 == 0) & (F.col("user_id") % 2 == 0)
    pages = table(spark, sf_dir, "events").select((F.col("user_id") % 40).cast("string").alias("source_system"), F.when(failed, "unavailable").otherwise("ok").alias("status"), F.lit(1).alias("rows"), F.lit(1).alias("reported_hits"))
    return responses.retrieval_state(pages).select("source_system", "pages", "failed", "retrieved", "state")


@query("mass_table_repair", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS target, p_size + 0.01 AS matched, 0.01::DOUBLE AS delta FROM part""")
def mass_table_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass-match rows; where a tab is missing, digits are split by the stated delta."""
    k, s = F.col("p_partkey"), F.col("p_size")
    gap = F.when(k % 2 == 0, "\t").otherwise("")
    text = F.concat(F.lit("target\tmatched\tdelta\tname\n"), s, F.lit(".0\t"), s, F.lit(".01"), gap, F.lit("0.01\tx\n"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(responses.mass_rows(text)).alias("r"))
    return rows.select("p_partkey", "r.target", F.round("r.matched", 6).alias("matched"), F.round("r.delta", 6).alias("delta"))


@query("normalised_identifiers", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'CHEBI:' || p_partkey WHEN 1 THEN 'ABC-' || p_partkey WHEN 2 THEN 'HMDB' || p_partkey ELSE 'c' || p_partkey END AS identifier, CASE p_partkey % 4 WHEN 0 THEN 'chebi' WHEN 1 THEN 'inchikey' WHEN 2 THEN 'hmdb' ELSE 'kegg' END AS scheme,
 CASE WHEN p_partkey % 2 = 0 THEN 'umol/l' ELSE 'mg/dl' END AS unit FROM part""")
def normalised_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    scheme = F.when(k % 4 == 0, "ChEBI ID").when(k % 4 == 1, "InChI-Key").when(k % 4 == 2, "hmdb id").otherwise("KEGG")
    value = F.when(k % 4 == 0, F.concat(F.lit(" "), k)).when(k % 4 == 1, F.concat(F.lit("abc-"), k)).when(k % 4 == 2, F.concat(F.lit("hmdb "), k)).otherwise(F.concat(F.lit("c"), k))
    unit = F.when(k % 2 == 0, "µmol per litre").otherwise("mg / dL")
    return table(spark, sf_dir, "part").select("p_partkey", X.norm_identifier(scheme, value).alias("identifier"), X.norm_scheme(scheme).alias("scheme"), X.norm_unit(unit).alias("unit"))


@query("release_years", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL")
def release_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of dates in text, some of them with words after the year."""
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.year("o_orderdate"), F.lit(" Spring")))
    return table(spark, sf_dir, "orders").groupBy(year_of(text).alias("year")).agg(F.count("*").alias("n"))

"""Queries over a paged service whose answers are recorded from the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import paged
from ..staging import discard, shared_dir, stage

PAGE, SWEEP, TRIES = 4, 20, 3

#: Sweeps, pages and the attempts that fail, as the recording has them; reached are the pages before the first that never comes.
_SQL = f"""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY source) AS in_source FROM documents),
s AS (SELECT doc_id, lang, coalesce(source, '') || '/' || (doc_id % CAST(ceil(in_source / {SWEEP}.0) AS BIGINT)) AS sweep FROM n),
p AS (SELECT *, CAST((row_number() OVER (PARTITION BY sweep ORDER BY doc_id) - 1) // {PAGE} AS INTEGER) AS page, count(*) OVER (PARTITION BY sweep) AS hits FROM s),
f AS (SELECT sweep, page, any_value(hits) AS hits, count(*) AS rows, CASE WHEN min(doc_id) % 11 = 0 THEN {TRIES} WHEN min(doc_id) % 5 = 0 THEN 1 ELSE 0 END AS failed FROM p GROUP BY sweep, page),
e AS (SELECT sweep, coalesce(min(page) FILTER (failed >= {TRIES}), 1000000000) AS ended, any_value(hits) AS hits FROM f GROUP BY sweep),
o AS (SELECT sweep, CASE WHEN ended = 0 THEN 'unavailable' ELSE 'ok' END AS status, CASE WHEN ended > 0 THEN e.hits END AS hit_count, CAST(count(*) FILTER (page < ended) AS INTEGER) AS pages,
  CAST(sum(CASE WHEN page < ended THEN failed + 1 WHEN page = ended THEN {TRIES} ELSE 0 END) AS INTEGER) AS attempts, CAST(coalesce(sum(rows) FILTER (page < ended), 0) AS BIGINT) AS retrieved, ended = 1000000000 AS pagination_complete,
  CASE WHEN ended = 1000000000 THEN '' ELSE 'HTTP 503' END AS detail FROM e JOIN f USING (sweep) GROUP BY sweep, ended, e.hits)
"""


def _sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recorded pages in the shared folder, read back through the data source."""
    folder = f"{shared_dir(spark)}/veridex/pages-{uuid.uuid4().hex}"
    discard(spark, folder)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    fails = F.when(F.col("first") % 11 == 0, TRIES).when(F.col("first") % 5 == 0, 1).otherwise(0)
    paged.record_pages(paged.sliced(docs, "source", "doc_id", SWEEP), folder, "doc_id", ["doc_id", "lang"], fails, PAGE).write.format("noop").mode("overwrite").save()
    return stage(paged.read_sweeps(spark, folder, TRIES), "sweeps")


@query("paged_records", _SQL + """SELECT p.sweep, p.page, CASE WHEN p.page = 0 THEN '*' ELSE substr(md5(p.sweep || '/' || p.page), 1, 16) END AS cursor, failed + 1 AS attempts,
 CAST(row_number() OVER (PARTITION BY p.sweep, p.page ORDER BY doc_id) - 1 AS INTEGER) AS position, pagination_complete, doc_id, lang
FROM p JOIN e USING (sweep) JOIN f ON f.sweep = p.sweep AND f.page = p.page JOIN o ON o.sweep = p.sweep WHERE p.page < ended""")
def paged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all sweeps: a page is asked again when it fails, and a page that never comes ends its sweep."""
    return paged.records(_sweeps(spark, sf_dir), "doc_id bigint, lang string")


@query("paged_outcomes", _SQL + "SELECT * FROM o")
def paged_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of each sweep, with its completeness."""
    return paged.outcomes(_sweeps(spark, sf_dir))


@query("paged_source_states", _SQL + """SELECT regexp_extract(sweep, '^(.*)/', 1) AS source_system, count(*) AS sweeps, CAST(sum(hit_count) AS BIGINT) AS hit_count, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(attempts) AS BIGINT) AS attempts,
 CAST(sum(retrieved) AS BIGINT) AS retrieved, bool_and(pagination_complete) AS pagination_complete, CASE WHEN bool_and(status = 'unavailable') THEN 'unavailable' WHEN sum(retrieved) = 0 THEN 'no_hits' ELSE 'ok' END AS status FROM o GROUP BY 1""")
def paged_source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by their sweeps: one truncated sweep leaves a source incomplete."""
    return paged.source_outcomes(paged.outcomes(_sweeps(spark, sf_dir)), F.regexp_extract("sweep", "^(.*)/", 1))

"""Entity dedup of bibliographic records: records that share an identifier are one entity, transitively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collections import compact
from .components import components
from .ranks import row_numbers

FILLED = ("doi", "pmid", "pmcid", "linked_published_doi", "cited_by_count", "abstract", "publication_types")
COMPARED = ("title", "publication_year", "journal")


def cluster_keys() -> Column:
    """doi, pmid, pmcid and linked published doi; only without any of them title and year."""
    clean = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    doi, linked = F.lower(clean("doi")), F.lower(clean("linked_published_doi"))
    found = compact(F.concat(F.lit("doi:"), doi), F.concat(F.lit("pmid:"), clean("pmid")), F.concat(F.lit("pmcid:"), F.upper(clean("pmcid"))), F.when(~linked.eqNullSafe(doi), F.concat(F.lit("doi:"), linked)))
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("title:"), bare, F.lit("|"), F.coalesce(clean("publication_year"), F.lit("")))))


def assign(records: DataFrame) -> DataFrame:
    """records with ``entity``, the least key of their component. Keys are nodes; a record is a star over its keys."""
    keyed = records.withColumn("_keys", cluster_keys()).withColumn("_least", F.array_min("_keys"))
    edges = keyed.select(F.col("_least").alias("u"), F.explode("_keys").alias("v")).filter("u <> v")
    found = components(edges).select(F.col("node").alias("_least"), "component")
    return keyed.join(found, "_least", "left").withColumn("entity", F.coalesce("component", "_least")).drop("_keys", "_least", "component")


def merge(assigned: DataFrame) -> DataFrame:
    """One row per entity: the best member (no preprint, longest abstract, source name), blanks filled from the next
    best, disagreements listed, and a preprint only if all members are. Reads is_preprint as boolean."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rank = F.struct(F.coalesce("is_preprint", F.lit(False)).cast("int"), -F.length(text("abstract")), text("source_system"), text("title"), text("publication_year"), text("journal"), text("doi"), text("pmid"))  # equal members are told apart by their own values
    filled = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in FILLED]
    first = lambda c, value: F.min_by(value, F.when(value.isNotNull(), rank)).alias(c)
    squeezed = {c: F.nullif(F.lower(F.trim(F.regexp_replace(text(c), r"\s+", " "))), F.lit("")) for c in COMPARED}
    conflict = [F.when(F.count_distinct(v) > 1, F.concat(F.lit(f"{c}: "), F.array_join(F.array_sort(F.collect_set(v)), " != "))) for c, v in squeezed.items()]
    return assigned.groupBy("entity").agg(
        F.count("*").alias("member_count"), F.min_by("title", rank).alias("title"), F.min_by(F.col("publication_year").cast("string"), rank).alias("publication_year"), F.min_by("journal", rank).alias("journal"),
        *[first(c, v) for c, v in zip(FILLED, filled)],
        F.bool_and(F.coalesce("is_preprint", F.lit(False))).alias("is_preprint"), F.bool_or(F.coalesce("is_preprint", F.lit(False))).alias("has_preprint_version"),
        F.array_join(F.array_sort(F.collect_set("source_system")), "; ").alias("source_systems"), F.concat_ws("; ", *conflict).alias("conflicts"),
    ).withColumn("has_conflicts", F.col("conflicts") != "")


def review_order(screened: DataFrame, classes, key: str = "entity", out: str = "review_rank") -> DataFrame:
    """Rows numbered by class order, citations, year and key."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("screen_class"))
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    return row_numbers(screened, [place, -number("cited_by_count"), -number("publication_year"), F.col(key)], out)

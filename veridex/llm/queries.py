"""The registered queries of this subpackage: thin calls of the operators with their production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_search, filter_audit, host_rules, language_id, near_dedup, oracles, quality_fm, sentencepiece_bpe, spelling, substring_dedup, suffix_dedup, token_store, toxicity
from .common import isolated, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    """Registers ``fn``; it runs in a session of its own, so that its settings don't reach the caller's."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(isolated(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), PIECES)


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    return language_id.report(table(spark, sf_dir, "documents"))


@_query
def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, base_failed and kept of every document."""
    return host_rules.report(table(spark, sf_dir, "documents"))


@_query
def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality_fm.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, hits of every document."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the written files."""
    return token_store.report(table(spark, sf_dir, "documents"), BYTES)


@_query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substring_dedup.report(table(spark, sf_dir, "documents"))


@_query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, for passages of 50 words and more."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source, order of the five filters and step."""
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the dictionary."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@_query
def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five best rows of every fiftieth vector."""
    return exact_search.top_k(table(spark, sf_dir, "embeddings"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

"""From raw documents to token ids: filter, dedup, decontaminate, encode. Each stage works on all that the one before kept.

Extra columns, whatever their names, pass all stages but the last; a table without rows gives one without rows; texts of any
length are worked on whole. What nulls, blanks, ties and repeated rows give is stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridex.llm import decontaminate, host_rules, near_dedup, sentencepiece_bpe, suffix_dedup
from veridex.llm.common import stage, table
from veridex.llm.queries import PIECES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host fails, go.

    Null and blank texts fail; a null source is a host of its own; a repeated row counts, and stays, as often as it occurs.
    """
    return host_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document of least doc_id stays.

    Of rows that repeat a doc_id one stays. A row without an id goes if its words equal those of one with an id, or of another
    without; blank texts copy nothing.
    """
    return near_dedup.keep(docs, shingle=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they occur first and are cut elsewhere.

    First is the least doc_id, then the least place, rows without an id before all; those are not cut. Texts without a
    repeated passage, null and blank ones too, stay as they are.
    """
    return suffix_dedup.remove(docs, keep_first=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go.

    Each row is judged by itself, with or without an id; null and blank texts stay; items without words, and an empty
    benchmark, contaminate nothing.
    """
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and digests of each row that is left; a null or empty text has no ids."""
    return sentencepiece_bpe.encoded(docs, PIECES)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL has no SentencePiece; tests/llm/test_pipeline_brute.py compares run() with a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

"""Rows that repeat a document, with and without an id, through deduplication and the pipeline."""

import random
from collections import Counter

import pytest
from conftest import prose

import corpus_pipeline
from veridex.llm import near_dedup, suffix_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", f"host{k % 2}", len(t or "")) for k, (i, t) in enumerate(pairs)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def long():
    rng = random.Random(11)
    return [prose(rng, 90) for _ in range(8)]


def test_one_row_of_a_repeated_document_stays(spark, long):
    a, b, c, d, e, f, g, h = long
    docs = frame(spark, [(1, a), (1, a), (2, b), (3, b), (3, b), (4, c), (4, h), (5, d), (5, d.upper()), (None, e), (None, e), (None, e + " "), (None, f), (6, g), (None, g), (None, None), (None, ""), (7, ""), (7, "")])
    got = Counter((r.doc_id, (r.text or "").lower().strip()) for r in near_dedup.keep(docs).collect())
    assert got == Counter([(1, a), (2, b), (4, min(c, h)), (5, d.lower()), (None, e), (None, f), (6, g), (None, ""), (None, ""), (7, "")])


@pytest.mark.parametrize("hot", [2, 50])
def test_all_copies_of_the_first_row_keep_a_passage(spark, long, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = frame(spark, [(1, long[0]), (1, long[0]), (2, "before " + long[0] + " after")])
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.remove(docs, keep_first=True).collect()) == [(1, long[0]), (1, long[0]), (2, "before after")]


def test_pipeline_keeps_the_text_of_a_repeated_row(spark, long, tmp_path):
    pairs = [(1, long[0]), (1, long[0]), (2, long[1]), (None, long[2]), (None, long[2]), (None, long[1])]
    frame(spark, pairs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this is in them")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "None"] and all(r.n_tokens > 90 for r in got)

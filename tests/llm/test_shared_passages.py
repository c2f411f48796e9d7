"""Passages that stand in documents without an id."""

import random

import pytest
from conftest import prose

from veridex.llm import suffix_dedup


@pytest.mark.parametrize("hot", [2, 50])
def test_passage_shared_with_a_document_without_an_id(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(3)
    passage, other, alone = prose(rng, 60), prose(rng, 60), prose(rng, 70)
    rows = [(None, "head " + passage), (1, "one " + passage + " two"), (None, other), (None, other), (2, alone), (None, prose(rng, 80))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.report(docs).collect() if r.doc_id is not None}
    assert got == {1: 60, 2: 0}
    left = sorted(((str(r.doc_id), r.text) for r in suffix_dedup.remove(docs, keep_first=True).collect()))
    assert left == sorted((str(i), "one two" if i == 1 else t) for i, t in rows)

"""Texts that share a doc_id: a frequent window of one must not move a window of another that starts at the same word."""

import random
from collections import Counter

import pytest
from conftest import prose

from veridex.llm import substring_dedup, suffix_dedup


def repeated_words(texts, width):
    seen = Counter(tuple(w[i : i + width]) for w in map(str.split, texts) for i in range(len(w) - width + 1))
    out = []
    for w in map(str.split, texts):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(sum(gone))
    return out


@pytest.mark.parametrize("operator, width", [(substring_dedup, 35), (suffix_dedup, 50)])
def test_windows_of_texts_that_share_an_id(spark, operator, width):
    rng = random.Random(23)
    rows, partners = [], []
    for k in range(12):
        often, once = prose(rng, 300), prose(rng, 300)
        rows += [(k, often), (k, once)] + [(1000 + 10 * k + i, often) for i in range(5)]
        rows.append((500 + k, once))
        partners.append((500 + k, once))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    whole = dict(zip([i for i, _ in rows], repeated_words([t for _, t in rows], width)))
    got = {r.doc_id: r.n_removed for r in operator.report(docs, hot=4).collect() if r.doc_id >= 500}
    assert got == {i: whole[i] for i, _ in rows if i >= 500}
    assert all(got[i] == 300 for i, _ in partners)

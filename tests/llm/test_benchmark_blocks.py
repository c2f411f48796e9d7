"""Operator 9 in one block and in several: every row by itself, with repeats, null ids and null item ids."""

from collections import Counter

import pytest
from test_classifiers import brute_hits

from veridex.llm import decontaminate


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_rows_stay_apart(spark, block):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (1, a), (2, b), (3, c), (3, c), (None, a), (None, a), (None, b), (None, c), (None, None), (4, a + " " + b)]
    items = [(10, " ".join(a.split()[3:20])), (None, " ".join(b.split()[:15])), (None, " ".join(b.split()[10:30])), (11, " ".join(b.split()[12:30])), (12, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, row int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")

    def brute(text):
        n, hit, _, _, bad = brute_hits(text, items)
        who = {i for i, t in items if t and brute_hits(text, [(0, t)])[1]}
        sha = decontaminate.hashlib.sha256(",".join(sorted(str(i) for i in who if i is not None)).encode()).hexdigest()
        return n, hit, len(who), sha, bad

    got = decontaminate.report(docs, benchmark, block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((i, *brute(t)) for i, t in rows)
    kept = decontaminate.keep(docs, benchmark, block)
    assert kept.columns == docs.columns
    assert sorted(r.row for r in kept.collect()) == [k for k, (_, t) in enumerate(rows) if not brute(t)[4]]

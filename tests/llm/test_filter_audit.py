"""Filter audit against a plain version, over the rows that break operators."""

import random
import re
from itertools import permutations

from veridex.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int, text string"


def plain(rows, labels):
    """rows: (doc_id, source, text); labels: (doc_id, quality, toxic)."""
    least = {}
    for doc_id, _, text in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    found = []
    for doc_id, source, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and least[text] < doc_id,
        }
        found.append((source or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in bad))
    out = set()
    for part in {f[0] for f in found}:
        own = [f[1:] for f in found if f[0] == part]
        rows_of = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                stay, gone = [d for d in left if c not in d[0]], [d for d in left if c in d[0]]
                rows_of[order, step] = [len(stay), len(gone), sum(c in d[0] for d in own) - len(gone), sum(d[0] == {c} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                left = stay
        share = {c: sum(v[1] for (o, s), v in rows_of.items() if o[s - 1] == c) for c in "ABCDE"}
        out |= {(part, o, s, *v, share[o[s - 1]]) for (o, s), v in rows_of.items()}
    return out


def test_all_orders_equal_a_plain_version(spark, docs, rows):
    rng = random.Random(5)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 60, 2)] + [(4, 1, 1, "again"), (4, 0, 0, "again"), (None, 1, 1, None), (999, 1, 1, None)]
    more = [(i, "Word $ " * 60 if i % 2 else "plain words " * 9, "en", "host1", 0, "x", "y", "z", i, None) for i in (70, 71, 72, 73, 73, -5)]
    more += [(None, None, None, None, None, None, None, None, None, None)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    found = [tuple(r) for r in filter_audit.report(both, spark.createDataFrame(labels, LABELS)).collect()]
    expected = plain([(r[0], r[3], r[1]) for r in rows + more], [l[:3] for l in labels])
    assert len(found) == len(set(found)) == len(expected) and set(found) == expected


def test_every_source_has_600_rows_and_steps_add_up(spark, docs, no_docs):
    labels = spark.createDataFrame([], LABELS)
    found = filter_audit.report(docs, labels).collect()
    by_part = {}
    for r in found:
        by_part.setdefault(r.part, []).append(r)
    assert "" in by_part and all(len(v) == 600 for v in by_part.values())
    for own in by_part.values():
        assert len({r.kept for r in own if r.step == 5}) == 1 and all(r.good_lost == r.toxic_lost == 0 for r in own)
        per_filter = {r.filter_order[r.step - 1]: r.shapley for r in own}
        first = [r for r in own if r.filter_order == "ABCDE"]
        assert sum(per_filter.values()) == 120 * sum(r.removed for r in first)
    assert filter_audit.report(no_docs, labels).count() == 0


def test_a_hot_text_and_a_hot_id(spark):
    rows = [(i, "copy of one text " * 20, "s") for i in range(3000)] + [(7, "own words " * 30, "s")] * 1000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(8)
    found = {(r.filter_order, r.step): r for r in filter_audit.report(docs, spark.createDataFrame([(7, 1, 0, None)], LABELS)).collect()}
    assert found["EABCD", 1].removed == 2999 and found["EABCD", 1].good_lost == 1  # the rows of id 7 have no smaller id
    assert found["BEACD", 1].removed == 4000 and found["BEACD", 1].good_lost == 1001

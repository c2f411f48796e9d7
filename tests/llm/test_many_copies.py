"""Rows that repeat an id or a text thousands of times: results as before, in time that follows the rows."""

import random
from collections import Counter

import pytest
from conftest import prose
from pyspark.sql import functions as F

from veridex.llm import language_id, quality_fm, substring_dedup, suffix_dedup

N = 20_000


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_copies_of_one_row(spark, operator):
    rng = random.Random(5)
    a, b, c, alone = (prose(rng, 80) for _ in range(4))
    texts = [prose(rng, 60) for _ in range(400)]
    rows = [(1, a)] * N + [(None, b)] * N + [(2, b), (3, c + " " + a), (4, alone)] + [(5, t) for t in texts] + [(6, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in operator.report(docs).collect())
    # rows of id 5 are texts of their own: one of them is copied
    assert got == Counter({(1, 80, 80): N, (None, 80, 0): N, (2, 80, 80): 1, (3, 160, 80): 1, (4, 80, 0): 1, (5, 60, 60): 1, (5, 60, 0): 399, (6, 60, 60): 1})


def test_first_occurrence_among_copies(spark):
    rng = random.Random(6)
    a = prose(rng, 80)
    docs = spark.createDataFrame([(3, a)] * 3000 + [(7, "before " + a)] * 3000, "doc_id bigint, text string").repartition(8)
    got = Counter((r.doc_id, r.text) for r in suffix_dedup.remove(docs, keep_first=True).collect())
    assert got == Counter({(3, a): 3000, (7, "before"): 3000})


def test_languages_of_repeated_rows(spark):
    english, german = "the cat sat on the mat and the dog ran", "der hund und die katze liegen auf dem bett"
    one = spark.createDataFrame([(8, english, "en")] * 8000, "doc_id bigint, text string, lang string").repartition(4)
    assert language_id.learn(one)["langs"] == ["en"]
    two = one.unionByName(spark.createDataFrame([(i, f"{german} {i}", "de") for i in range(100, 300)], one.schema))
    assert set(language_id.learn(two)["langs"]) == {"en", "de"}
    assert set(language_id.learn(two, per_language=1)["langs"]) == {"en", "de"}
    assert language_id.learn(two, languages=1)["langs"][0] == "de"
    got = language_id.report(two).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 8000, "de": 200}


def test_the_sample_of_long_texts_is_bounded(spark):
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{i}x{k}" for k in range(30_000))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id bigint, quality int")
    held = []
    plain = quality_fm.fit
    try:
        quality_fm.fit = lambda row, *rest: held.append(len(row)) or plain(row, *rest)
        quality_fm.learn(docs, labels, entries=60_000)
    finally:
        quality_fm.fit = plain
    assert 2 <= held[0] / 20_000 and held[0] <= 2 * 60_000
    assert quality_fm.report(docs, labels).filter(F.col("score").between(0, 1)).count() == 24

"""Extra columns that have the names of the operators' own: kept with their values by all stages but the last."""

import random

import pytest
from conftest import prose

import corpus_pipeline
from veridex.llm import decontaminate, host_rules, near_dedup, suffix_dedup

NAMES = ["stay", "stay_id", "key", "again", "whole", "blank", "place", "size", "print1", "Print2", "row", "ROW_", "spans", "found_key", "own_key", "host", "veridex_row", "veridex_spans", "veridex_key", "veridex_host", "node", "component", "rep", "kept", "n", "f1"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    a, b = prose(rng, 90), prose(rng, 120)
    texts = [(1, a), (1, a), (2, a), (3, b), (None, b), (None, b), (4, prose(rng, 20) + " " + a[: len(a) // 2]), (5, None), (6, "")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", f"h{k % 2}", len(t or ""), *[f"{n}{k}" for n in NAMES]) for k, (i, t) in enumerate(texts)], schema).repartition(3)


def extras(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def test_every_stage_keeps_them(spark, frame):
    before = extras(frame)
    benchmark = spark.createDataFrame([(1, "some words that nobody has written anywhere"), (2, "other words of an item in a block of its own")], "item_id bigint, text string")
    for out in (host_rules.keep(frame), near_dedup.keep(frame), suffix_dedup.remove(frame, keep_first=True), decontaminate.keep(frame, benchmark), decontaminate.keep(frame, benchmark, 1)):
        assert out.columns == frame.columns and set(extras(out)) <= set(before)
    assert extras(suffix_dedup.remove(frame)) == before == extras(decontaminate.keep(frame, benchmark, 1))


def test_the_pipeline_runs(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this is in them")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4"]

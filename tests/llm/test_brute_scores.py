"""Operators 2, 4 and 5 against plain loops, and what bounds their samples."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.llm import language_id, quality_fm, toxicity
from veridex.llm.textkit import encode, hash_words

SF = "/root/testdata/sf0.001"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def brute_counts(text):
    """n-grams of one to three bytes of a text whose other ASCII characters are one blank."""
    raw = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" ")
    out = [0] * language_id.BINS
    for n in (1, 2, 3):
        for k in range(len(raw) - n + 1):
            value = int.from_bytes(raw[k : k + n], "big")
            out[((value * 2654435761 + n * 40503) & 0xFFFFFFFF) >> 20] += 1
    return out


def test_language_is_the_nearest_centroid(spark):
    docs, _ = tables(spark)
    model = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.report(docs).collect()}
    rows = docs.select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    for r in rows:
        x = [math.log1p(c) * float(w) for c, w in zip(brute_counts(r.text), model["idf"])]
        norm = math.sqrt(sum(v * v for v in x)) or 1.0
        cosine = [sum(a * float(b) for a, b in zip(x, c) if a) / norm for c in model["centroids"]]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        if not any(ch.isalpha() for ch in r.text or ""):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        rival = max((c for c, lang in zip(cosine, model["langs"]) if lang != model["langs"][best]), default=-1.0)
        if cosine[best] - rival < 1e-5:
            continue
        assert got[r.doc_id].lang_pred == model["langs"][best]
        assert math.isclose(got[r.doc_id].score, max(0.0, cosine[best] / (1 + math.exp(-20 * (cosine[best] - rival)))), abs_tol=1e-4)
        assert got[r.doc_id].rejected == (cosine[best] < model["reach"][best]) or abs(cosine[best] - model["reach"][best]) < 1e-5


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(60)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 60}"]) for _ in range(30)), f"l{i % 60}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert set(language_id.learn(docs)["langs"]) == set(words)
    got = language_id.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_quality_counts_every_pair(spark):
    """All pairs of features multiplied one by one, where the operator uses the sum of squares."""
    docs, labels = tables(spark)
    m = quality_fm.learn(docs, labels)
    got = {r.doc_id: r for r in quality_fm.report(docs, labels).collect()}
    rows = [r for r in docs.select("doc_id", "text").orderBy("doc_id").limit(60).collect() if len((r.text or "").split()) < 150][:12]
    for r in rows:
        low = [int(h) % quality_fm.BINS for h in hash_words([t.lower() for t in encode([r.text])]).hashes]
        count = {b: low.count(b) for b in set(low)}
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in count.values())) or 1e-9
        x = {b: math.log1p(c) / norm for b, c in count.items()}
        stats = quality_fm.features([r.text])[3][0]
        for k in range(quality_fm.STATS):
            x[quality_fm.BINS + k] = min(4.0, max(-4.0, (stats[k] - m.mean[k]) / m.scale[k])) / math.sqrt(quality_fm.STATS)
        z = m.w0 + sum(m.w[i] * v for i, v in x.items())
        items = sorted(x.items())
        for a in range(len(items)):
            for b in range(a + 1, len(items)):
                z += float(np.dot(m.v[items[a][0]], m.v[items[b][0]])) * items[a][1] * items[b][1]
        assert math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs_tol=1e-5)


def brute_toxicity(lexicon, text):
    """Every entry sought at every place; words inside exception phrases don't count."""
    folded = toxicity.fold(text)
    safe = set()
    for phrase in lexicon.exceptions:
        at = folded.find(f" {phrase} ")
        while at >= 0:
            safe |= set(range(at, at + len(phrase) + 1))
            at = folded.find(f" {phrase} ", at + 1)
    best = {}
    for at, ch in enumerate(folded):
        if ch == " " and at not in safe:
            found = [w for e, w in lexicon.weights.items() if folded.startswith(e, at)]
            if found:
                best[at] = max(found)
    z = lexicon.slope * sum(best.values()) / math.sqrt(1 + math.log1p(len(folded) / 64)) + lexicon.offset
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), len(best)


def test_toxicity_counts_every_entry(spark):
    docs, labels = tables(spark)
    lexicon = toxicity.learn(docs, labels)
    odd = spark.createDataFrame([(-1, "Such a trash can, you 1d10t"), (-2, "trash " * 40), (-3, None), (-4, ""), (-5, "class clown clown")], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    own = {r.doc_id: lexicon.score(r.text) for r in odd.collect()}
    for r in rows.collect():
        if len(r.text or "") > 5000:
            continue
        score, hits = brute_toxicity(lexicon, r.text)
        mine = own[r.doc_id] if r.doc_id < 0 else (got[r.doc_id].score, got[r.doc_id].hits)
        assert mine[1] == hits and math.isclose(mine[0], score, abs_tol=1e-9)


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.report(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9 and sum(r.predicted for r in clean) / len(clean) < 0.03


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "1", "$" * 1_000_000, "a1" * 500_000, "@1" * 500_000, "a" + "1" * 1_000_000 + "-"])
def test_unbroken_text_folds_in_linear_time(text):
    began = time.perf_counter()
    toxicity.fold(text)
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize("column", ["toxic", "quality"])
def test_sample_is_bounded_by_rows(spark, column):
    rows = [(1, f"text {i % 7}") for i in range(4000)] + [(k, f"other {k}") for k in range(2, 40)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 2 == 1), int(k % 2 == 1)) for k in range(1, 40)] + [(2, 1, 1), (3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.sample(docs, labels, column, 500, F.lit(False)).collect()
    assert len(got) == len({r.doc_id for r in got}) == 39
    assert {r.doc_id: r.text for r in got}[1] == "text 0" and {r.doc_id: r.label for r in got}[2] == 1
    few = toxicity.sample(docs, labels, column, 5, F.lit(False)).collect()
    assert sorted(r.label for r in few) == [0] * 5 + [1] * 5

"""Operators 2 to 5 and 9: held-out accuracy, brute force, and defined results for odd rows."""

import binascii
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridex.llm import decontaminate, host_rules, language_id, quality_fm, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def crc(doc, n):
    return binascii.crc32(str(doc).encode()) % n


def brute_quality(text):
    w = WORD.findall(text or "")
    count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {i for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_host_rules_measures(docs, no_docs, rows):
    got = host_rules.report(docs).collect()
    own = Counter((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert own == Counter((str(r[0]), *brute_quality(r[1])) for r in rows)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert host_rules.report(no_docs).count() == 0 and host_rules.keep(no_docs).count() == 0
    assert host_rules.keep(docs).count() == sum(r.kept for r in got) and host_rules.keep(docs).columns == docs.columns


def test_bad_hosts_take_their_documents_along(spark):
    rng = random.Random(1)
    good = lambda: " ".join(str(rng.random()) for _ in range(30))
    rows = [(i, "spam spam" if i % 10 else good(), "bad") for i in range(200)] + [(1000 + i, good() if i % 20 else "x", f"ok{i % 5}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    verdict = {r.source: r for r in host_rules.hosts(host_rules.metrics(docs)).collect()}
    assert verdict["bad"].rejected and not any(v.rejected for k, v in verdict.items() if k != "bad")
    assert verdict["bad"].shrunk_rate < 0.9 + 1e-9  # shrunk towards the other hosts
    assert {r.source for r in host_rules.keep(docs).collect()} == {f"ok{k}" for k in range(5)}


def test_one_host_has_a_defined_prior(spark):
    docs = spark.createDataFrame([(1, "a", "h"), (2, " ".join(map(str, range(20))), "h")], "doc_id bigint, text string, source string")
    assert [r.kept for r in host_rules.report(docs).orderBy("doc_id").collect()] == [False, True]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_odd_rows(spark, docs, no_docs, rows):
    got = {r.doc_id: r for r in language_id.report(docs).collect()}
    for r in rows:
        letters = any(c.isalpha() for c in r[1] or "")
        assert (got[r[0]].lang_pred == "und") == (not letters)
    assert language_id.report(no_docs).count() == 0
    unknown = language_id.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"} and all(r.score == 0 for r in unknown)


def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(spark, no_docs):
    docs, labels = labelled(spark)
    got = quality_fm.report(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93
    assert quality_fm.report(no_docs, labels).count() == 0


def test_toxicity_held_out(spark, no_docs):
    docs, labels = labelled(spark)
    got = toxicity.report(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.3) for r in got)
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.6 and sum(r.predicted for r in clean) / len(clean) < 0.03
    assert toxicity.report(no_docs, labels).count() == 0


@pytest.mark.parametrize("module", [quality_fm, toxicity])
def test_without_labels_scores_are_defined(docs, rows, spark, module):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = module.report(docs, none).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    one = spark.createDataFrame([(10, 1, 1), (11, None, None), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert module.report(docs, one).count() == len(rows)


def test_folding_and_exceptions():
    assert toxicity.fold("You 1d10t!!") == toxicity.fold("you idiot") == " you idiot "
    assert "idiot" in toxicity.fold("іdіоt") and toxicity.fold("m0r0n") == " moron " and toxicity.fold(None) == "  "
    assert "123 456" in toxicity.fold("123 456")
    lexicon = toxicity.Lexicon({" trash ": 5.0, " trash": 3.0}, 1.0, -3.0)
    assert lexicon.total(toxicity.fold("such trash")) == (5.0, 1) and lexicon.total(toxicity.fold("a trash can")) == (0, 0)
    assert lexicon.score("trash " + "fine " * 1000)[0] < lexicon.score("trash")[0]


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    w, hit, who = split(text), set(), set()
    for item, t in items:
        p = split(t)
        size = min(13, len(p))
        for k in range(len(p) - size + 1 if size else 0):
            for s in range(len(w) - size + 1):
                if w[s : s + size] == p[k : k + size]:
                    hit |= set(range(s, s + size))
                    who.add(item)
    sha = hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest()
    return len(w), len(hit), len(who), sha, len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination(spark, docs, no_docs, rows, block):
    texts = [r[1] for r in rows if r[1] and 40 < len(r[1].split()) < 300]
    items = [(1, " ".join(texts[0].split()[5:30])), (2, texts[1].upper()), (30, "one"), (4, None), (5, "... !"), (6, "two words"), (7, " ".join(texts[0].split()[5:30])), (8, "la la la la"), (9, "日本語")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.report(docs, benchmark, block).collect()
    brute = {r[1]: brute_hits(r[1], items) for r in rows}
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((r[0], *brute[r[1]]) for r in rows)
    kept = decontaminate.keep(docs, benchmark, block)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r[0], r[1]) for r in rows if not brute[r[1]][4])
    assert decontaminate.report(no_docs, benchmark, block).count() == 0
    assert decontaminate.report(docs, benchmark.filter("false"), block).filter("contaminated").count() == 0

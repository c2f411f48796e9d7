"""corpus_pipeline.run() against a plain version of its five stages, with nulls, repeats, clashing columns and empty tables."""

import hashlib
import random
import statistics
from collections import Counter

import public_tokenizers
import sentencepiece
from conftest import SCHEMA, prose
from test_classifiers import brute_hits, brute_quality
from test_duplicates import LOWER, WORD

import corpus_pipeline

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ITEMS = []


def corpus():
    rng = random.Random(21)
    passage, bench = prose(rng, 80), prose(rng, 30)
    texts = [prose(rng, rng.randint(15, 160)) for _ in range(25)]
    near = prose(rng, 150)
    rows = [(i, t, "en", f"host{i % 3}") for i, t in enumerate(texts)]
    rows += [(100 + i, " ".join([*near.split()[:-1], f"end{i}"]), "de", "host0") for i in range(4)]  # near copies
    rows += [(110 + i, prose(rng, 30) + "\n" + passage + " " + prose(rng, 40), None, "host1") for i in range(3)]  # a passage
    rows += [(120, prose(rng, 20) + " " + bench, "fr", "host2"), (121, prose(rng, 700) + " " + bench, "fr", "host2")]  # over and under the limit
    rows += [(130, texts[0], "en", "host0"), (130, texts[0], "en", "host0"), (131, texts[3] + " ", "en", None)]  # copies and a repeated row
    rows += [(140, prose(rng, 90), None, None)] * 3
    rows += [(None, prose(rng, 70), None, "host1")] * 2 + [(None, texts[5], "en", "host1"), (None, None, None, None)]
    rows += [(150, None, "en", "host0"), (151, "", "en", "host0"), (152, "la " * 40, "en", "host0"), (153, "few words", "en", "host0"), (154, " \n\t ", None, "host0")]
    rows += [(200 + i, "spam spam spam", "en", "badhost") for i in range(60)] + [(300, prose(rng, 60), "en", "badhost")]  # goes with its host
    rows += [(400 + 20 * h + i, prose(rng, 20), "en", f"many{h}") for h in range(6) for i in range(3)]
    ITEMS[:] = [(1, bench), (2, None), (None, prose(rng, 20)), (3, "...")]
    rng.shuffle(rows)
    return rows


def brute(rows):
    # host rules
    failed = [brute_quality(r[1])[5] for r in rows]
    by = {}
    for r, bad in zip(rows, failed):
        by.setdefault(r[3], []).append(bad)
    rates = [sum(v) / len(v) for v in by.values()]
    m, v = statistics.mean(rates), statistics.variance(rates)
    assert 0 < v < m * (1 - m)
    weight = m * (1 - m) / v - 1
    hosts = {h for h, v in by.items() if (sum(v) + m * weight) / (len(v) + weight) > 0.8}
    assert hosts == {"badhost"}
    rows = [r for r, bad in zip(rows, failed) if not bad and r[3] not in hosts]
    # near-duplicates: the least document of a group, one row of a repeated one, texts without an id last
    grams = lambda t: frozenset(tuple(w[k : k + 5]) for w in [WORD.findall(t.translate(LOWER))] for k in range(len(w) - 4))
    named = {r[0]: r for r in rows if r[0] is not None}
    sets = {d: grams(r[1]) for d, r in named.items()}
    label = {d: d for d in named}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sorted(named):
        for b in sorted(named):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    kept = [named[d] for d in sorted(named) if root(d) == d]
    seen = set(sets.values())
    for r in (r for r in rows if r[0] is None):
        if grams(r[1]) not in seen:
            seen.add(grams(r[1]))
            kept.append(r)
    # passages: the first occurrence of a window stays, nothing is cut without an id
    order = sorted(kept, key=lambda r: (r[0] is not None, r[0]))
    first = {}
    for d, r in enumerate(order):
        w = WORD.findall(r[1])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), (d, k))
    cut = []
    for d, r in enumerate(order):
        w = WORD.findall(r[1])
        gone = set()
        for k in range(len(w) - 49):
            if r[0] is not None and first[tuple(w[k : k + 50])] != (d, k):
                gone |= set(range(k, k + 50))
        cut.append((r[0], " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r[1], *r[2:]))
    assert sum(a != b for a, b in zip(order, cut)) == 2
    # decontamination and encoding
    clean = [r for r in cut if not brute_hits(r[1], ITEMS)[4]]
    assert len(clean) == len(cut) - 1
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = Counter()
    for doc, text, lang, source in clean:
        ids = LIBRARY.encode(text)
        out[(doc, lang, source, len(ids), tuple(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))] += 1
    return out


def write(spark, folder, rows, schema, clash):
    full = [(d, t, lang, source, len(t or ""), *clash) for d, t, lang, source in rows]
    spark.createDataFrame(full, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    rows = corpus()
    write(spark, tmp_path, rows, SCHEMA, ("x", "y", "z", 1, None))
    got = Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], SCHEMA, ())
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and "ids" in got.columns


def test_pipeline_leaves_the_settings_of_its_session(spark, tmp_path):
    write(spark, tmp_path, corpus()[:40], SCHEMA, ("x", "y", "z", 1, None))
    before = dict(spark.conf.getAll)
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert dict(spark.conf.getAll) == before

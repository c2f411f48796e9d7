"""Spelling variants against a plain version: all pairs by edit distance."""

import random
import re
import zlib
from collections import Counter

import pytest

from veridex.llm import spelling


def plain_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def corpus(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    shared = "".join(rng.choice("abc") for _ in range(9))
    texts = [None, "", " .,;", "÷×ÿÀß" * 3 + " Straße", "A" * 5000 + " " + "A" * 4999 + "b " + "A" * 4999]
    for _ in range(300):
        words = []
        for _ in range(40):
            w = rng.choice(base) if rng.random() < 0.8 else shared + rng.choice("abcdefghijklmnop") + rng.choice("xyz")
            if rng.random() < 0.3:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abcé") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abÉZ") + w[k + 1 :]])
            words.append(w if rng.random() < 0.9 else w.upper())
        texts.append(rng.choice([" ", "-", "\n", "1"]).join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[4], (None, texts[10]), (None, texts[10]), (12, texts[12])]


@pytest.mark.parametrize("limit", [2, 5, 64])
def test_variants_equal_a_plain_version(spark, limit):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id bigint, text string, word string, n int").repartition(5)
    found = [tuple(r) for r in spelling.variants(docs, limit=limit).collect()]
    expected = plain(rows)
    assert len(expected) > 500 and any(r[1] for r in expected) and len(found) == len(expected) and set(found) == expected


def test_chains_end_at_the_last_form(spark):
    counts = {"abcdefgh": 4000, "abcdefgx": 300, "abcdefyx": 20, "abcdezyx": 2}
    known = [(w, n) for w, n in counts.items()]
    texts = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(known)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert {tuple(found[w]) for w in found} == plain(texts)
    assert max(found.values(), key=lambda r: r.n).root == max(found.values(), key=lambda r: r.n).word


def test_empty_tables(spark, no_docs):
    assert spelling.variants(no_docs).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).count() == 0


def test_a_block_is_bounded_by_the_alphabet_after_subdivision(spark):
    """A third of the words share all but two code points."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    words = ["commonstem" + a + b for a in letters for b in letters] + ["".join(random.Random(i).choices(letters, k=12)) for i in range(1400)]
    known = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    sizes = spelling.blocks(known).groupBy(*spelling.BLOCK).count().agg({"count": "max"}).first()[0]
    assert sizes <= 64
    near = spelling.near_words(spelling.blocks(known)).filter("word like 'commonstem%'")
    assert near.count() == near.distinct().count() == 26 * 26 * 50

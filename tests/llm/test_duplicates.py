"""Operators 7, 8 and 10 against brute force over whole texts."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from veridex.llm import near_dedup, repeats, substring_dedup, suffix_dedup
from veridex.llm.common import stage
from veridex.llm.repeats import SALTED
from veridex.llm.sketches import SEGMENT, cells, cells_for, count_min, decode_counts, encode_counts, estimate, segment_of
from veridex.llm.textkit import encode, gram_hashes, hash_words, minimisers, mix
from veridex.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_repeats(rows, width):
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    count = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = Counter()
    for doc, w in words:
        gone = bytearray(len(w))
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = b"\1" * width
        if doc is None:
            gone = bytearray(len(w))
        out[(str(doc), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode("utf-8", "surrogatepass")).hexdigest())] += 1
    return out


def found(df):
    return Counter((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot,very_hot", [(2, 3), (200, 1 << 20), (2, 1 << 20)])
@pytest.mark.parametrize("width", [64, 1 << 20, None])
def test_substring_dedup(docs, rows, hot, very_hot, width):
    """Hot keys, a tiny sketch and one of many segments change the way, never the result."""
    assert found(substring_dedup.report(docs, hot=hot, width=width, very_hot=very_hot)) == brute_repeats(rows, 35)


@pytest.mark.parametrize("hot", [2, 50])
def test_suffix_dedup(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert found(suffix_dedup.report(docs)) == brute_repeats(rows, 50)


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_suffix_dedup_in_partitions(spark, docs, rows, partitions):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(suffix_dedup.report(docs)) == brute_repeats(rows, 50)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("sizes", [(120_000, 1), (1, 120_000), (100_001, 1, 1), (3, 100_000, 2, 150_000), (100_002,)])
@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_long_runs_of_equal_suffixes(spark, sizes, partitions):
    """Every suffix with an equal one is marked, wherever a run is flushed and a partition ends."""
    kept = spark.range(sum(sizes)).selectExpr("case " + " ".join(f"when id < {sum(sizes[: k + 1])} then {k}" for k in range(len(sizes))) + " end as gram", "id as doc_key", "0 as place").selectExpr("cast(gram as bigint) gram", "doc_key", "place")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix_dedup.marked_places(stage(suffix_dedup.neighbours(kept), "neighbours"), 200)
        assert got.count() == sum(n for n in sizes if n > 1)
        salts = {r.doc_key: r.s for r in got.selectExpr("doc_key", "places[0].salts as s").collect()}
        ends = np.cumsum(sizes)
        for end, n in zip(ends, sizes):
            own = [salts[d] for d in range(end - n, end) if d in salts]
            assert len(own) == (n if n > 1 else 0) and all((s > 0) == (n >= 200) and s <= -(-n // SALTED) for s in own)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_matches_go_left_and_right():
    """Against all pairs of suffixes, in a few words that repeat often."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        length, side, m = 8, 6, 40
        gram = rng.integers(0, 3, m).astype(np.uint64)
        lead, tail = rng.integers(0, side + 1, m), rng.integers(2, length + 1, m)
        left, right = rng.integers(1, 3, (m, side)).astype(np.uint64), rng.integers(1, 3, (m, length)).astype(np.uint64)
        left[np.arange(side) >= lead[:, None]] = 0
        right[np.arange(length) >= tail[:, None]] = 0
        got = {(o, int(r)) for o, rows, _ in suffix_dedup.matches(gram, lead, tail, left, right, length) for r in rows}
        want = set()
        for o in range(side + 1):
            for i in range(m):
                for j in range(m):
                    fits = all(lead[k] >= o and tail[k] >= length - o for k in (i, j))
                    if i != j and fits and gram[i] == gram[j] and (left[i, :o] == left[j, :o]).all() and (right[i, : length - o] == right[j, : length - o]).all():
                        want.add((o, i))
        assert got == want


@pytest.mark.parametrize("hot", [2, 50])
def test_first_occurrences_stay(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    left = {r.doc_id: r for r in suffix_dedup.remove(docs, keep_first=True).collect()}
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    first = {}
    for doc, w in sorted(words, key=lambda x: (x[0] is not None, x[0])):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), (doc, k))
    for doc, w in words:
        gone = bytearray(len(w))
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] != (doc, k) and doc is not None:
                gone[k : k + 50] = b"\1" * 50
        text = next(r[1] for r in rows if r[0] == doc)
        if not any(gone):
            assert left[doc].text == text
        elif [r[0] for r in rows].count(doc) == 1:
            assert left[doc].text.split(" ") == [x for x, g in zip(w, gone) if not g] or left[doc].text == ""
            assert left[doc].n_chars == len(left[doc].text)
    assert set(left[0].asDict()) == set(docs.columns)


def test_empty_tables(no_docs):
    assert substring_dedup.report(no_docs).count() == 0
    assert suffix_dedup.report(no_docs).count() == 0
    assert suffix_dedup.remove(no_docs, keep_first=True).count() == 0
    assert near_dedup.classes(no_docs).count() == 0 and near_dedup.keep(no_docs).count() == 0


def test_sketch_never_counts_too_few(spark):
    keys = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    many = np.concatenate([keys, keys[:100], keys[:10], np.repeat(keys[:1], 400)])
    parts = spark.createDataFrame([(bytearray(p.tobytes()),) for p in np.array_split(many, 7)] + [(None,)], "keys binary")
    for width in (16, 1 << 12):
        counters = count_min(parts, width)
        true = Counter(many.tolist())
        assert all(e >= true[k] for k, e in zip(keys.tolist(), estimate(counters, keys).tolist()))


def test_counts_are_rounded_up():
    n = np.array([0, 1, 2, 199, 200, 201, 500, 12_345, 2_000_000])
    got = decode_counts(encode_counts(n))
    assert (got >= n).all() and (got[:5] == n[:5]).all() and (got <= n * 1.2 + 1).all()


def test_sketch_keeps_its_share_of_false_repeats():
    """Keys that occur once pass at the stated rate, whatever their number."""
    for many in (3_000, 300_000):
        keys = np.random.default_rng(many).integers(0, 2**63, many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        keys = mix(keys)
        width = cells_for(many)
        counters = np.zeros((1, 2, width), np.int64) if width <= SEGMENT else np.zeros((width // SEGMENT, 2, SEGMENT), np.int64)
        for row in range(2):
            np.add.at(counters, (segment_of(keys, counters.shape[0]), row, cells(keys, row, counters.shape[2])), 1)
        assert (estimate(encode_counts(counters), keys) >= 2).mean() < 0.16


def test_equal_windows_choose_equal_minimisers():
    shared = " ".join(f"w{i}" for i in range(50))
    places = []
    for head in ("a b c ", "x ", "long head of other words "):
        words = hash_words(encode([head + shared + " tail"]))
        start = len(head.split())
        places.append(int(minimisers(words.hashes, 35, 6)[start + 5] - start))
    assert len(set(places)) == 1


def brute_components(rows, n, percent):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return Counter((str(rows[i][0]), len(sets[i]), str(least[find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_dedup(docs, rows, n, percent):
    got = near_dedup.classes(docs, n, percent).collect()
    assert Counter((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, n, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_many_near_copies_need_no_pairs(spark):
    """Copies that differ from a base, but less from it than from one another."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(120):
        words = list(base)
        for k in rng.choice(150, rng.integers(0, 9), replace=False):
            words[k] = f"z{d}_{k}"
        rows.append((d, " ".join(words)))
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 3, 85).collect()
    assert Counter((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 3, 85)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, errors = rng.integers(0, 2**63, 300, dtype=np.uint64), []
    for k in range(30):
        a = np.unique(np.concatenate([shared, rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        b = np.unique(np.concatenate([shared, rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        s = near_dedup.signatures([a, b, a[:3], np.zeros(0, np.uint64)])
        errors.append((s[0] == s[1]).mean() - 300 / 380)
        assert np.isfinite(s[:3]).all() and np.isinf(s[3]).all()
    assert abs(np.mean(errors)) < 0.02


def test_signatures_follow_the_plain_algorithm():
    """Against one element at a time with an explicit permutation."""
    element = np.random.default_rng(9).integers(0, 2**63, 7, dtype=np.uint64)
    from veridex.llm.textkit import mix

    slots, expected = 20, np.full(20, np.inf)
    for e in element:
        p = list(range(slots))
        for j in range(slots):
            x = int(mix(np.array([e], np.uint64) + np.uint64(((j + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))[0])
            k = j + (x >> 40) % (slots - j)
            p[j], p[k] = p[k], p[j]
            expected[p[j]] = min(expected[p[j]], j + (x & ((1 << 40) - 1)) / (1 << 40))
    assert (near_dedup.signatures([element], slots)[0] == expected).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_word_hashes_tell_words_apart():
    words = [f"{a}{b}" for a in "abcé日" for b in range(300)] + ["a", "aa", "a" * 5000, "\x00", "\x00\x00"]
    assert len(np.unique(hash_words(encode([" ".join(words)])).hashes)) == len(words)
    assert len(gram_hashes(np.zeros(2, np.uint64), 3)) == 0
    assert repeats.cut(None, None) == ([], 0)


@pytest.mark.parametrize("counters", [16, 1 << 23])
def test_prefixes_find_links_between_components(spark, counters, monkeypatch):
    """Families of one template whose members are over, at and under the threshold; a full sketch changes nothing."""
    monkeypatch.setattr(near_dedup, "COUNTERS", counters)
    rng = np.random.default_rng(12)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(120)]
        for d in range(60):
            words = list(base)
            for k in rng.choice(120, rng.integers(0, 12), replace=False):
                words[k] = f"z{family}_{d % 23}_{k}"
            rows.append((family * 100 + d, " ".join(words[: 120 - int(rng.integers(0, 6))])))
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 3, 85).collect()
    assert Counter((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 3, 85)

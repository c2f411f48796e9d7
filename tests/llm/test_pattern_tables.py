"""Operator 9's tables: exact against plain search over few words, what a full block takes, and how much is skipped."""

import random
import subprocess
import sys

import numpy as np
import pytest

from veridex.llm import decontaminate

FULL = """
import resource, sys
import numpy as np
sys.path.insert(0, {root!r})
from veridex.llm import decontaminate
rng = np.random.default_rng(1)
items, size = [], 0
while size < decontaminate.BLOCK_BYTES:
    text = " ".join(f"word{{x}}" if x % 3 else f"w{{x % 50}}" for x in rng.integers(0, 60_000, 400))
    items.append((len(items), text))
    size += len(text)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m = decontaminate.Matcher(items)
after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
windows = sum(len(e.whole) for e in m.engines)
found = m.search(decontaminate.words_of([items[7][1], "nothing of this is there " * 50, items[9][1][50:]]))
print((after - before) // 1024, windows, sum(e.nbytes() for e in m.engines) / windows, [7 in found[1][0], found[0][1] == [], 9 in found[1][2]])
"""


def test_a_full_block_fits_a_worker():
    root = decontaminate.__file__.split("/veridex/")[0]
    said = subprocess.run([sys.executable, "-c", FULL.format(root=root)], capture_output=True, text=True, timeout=300, check=True).stdout.split(maxsplit=3)
    assert int(said[0]) < 600 and int(said[1]) > 2_000_000 and float(said[2]) < 48 and said[3].strip() == "[True, True, True]", said


def plain(text, items, window):
    hit, who = set(), set()
    for item, words in items:
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            for j in range(len(text) - size + 1):
                if text[j : j + size] == words[i : i + size]:
                    hit |= set(range(j, j + size))
                    who.add(item)
    return hit, who


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_search_equals_plain_search(window):
    rng = random.Random(window)
    few = ["a", "B", "c9", "é", "日本"]
    items = [(k if k % 5 else None, [rng.choice(few) for _ in range(rng.choice([0, 1, 2, 3, window, window + 4]))]) for k in range(30)]
    texts = [[rng.choice(few) for _ in range(rng.choice([0, 1, 4, 60, 700]))] for _ in range(25)]
    low = lambda words: [w.lower() if w.isascii() else w for w in words]
    matcher = decontaminate.Matcher([(i, ", ".join(w) if w else None) for i, w in items], window)
    spans, who = matcher.search(decontaminate.words_of([" - ".join(t) for t in texts] + [None]))
    assert spans[-1] == [] and who[-1] == []
    for t, s, w in zip(texts, spans, who):
        hit, expected = plain(low(t), [(i, low(x)) for i, x in items], window)
        assert {k for a, b in zip(s[0::2], s[1::2]) for k in range(a, b)} == hit and set(w) == expected


def test_clean_texts_are_mostly_skipped(monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(f"i{rng.randrange(5_000)}" for _ in range(100))) for k in range(50)]
    matcher = decontaminate.Matcher(items)
    looked, plain_search = [], np.searchsorted
    monkeypatch.setattr(decontaminate.np, "searchsorted", lambda a, v, **o: looked.append(np.size(v)) or plain_search(a, v, **o))
    words = decontaminate.words_of([" ".join(f"d{rng.randrange(5_000)}" for _ in range(20_000))])
    looked.clear()
    assert [list(x) for x in matcher.engines[0].candidates(words)] == [[], []]
    assert sum(looked) < 20_000 / 11


def test_no_items():
    matcher = decontaminate.Matcher([(1, None), (2, "")])
    assert matcher.search(decontaminate.words_of(["some words", None])) == ([[], []], [[], []])

"""Hits inside exception phrases, of which a long text may hold very many."""

import time

from veridex.llm.toxicity import Lexicon


def plain(lexicon, text):
    """Each hit against each phrase."""
    found = {}
    for entry, weight in lexicon.weights.items():
        at = text.find(entry)
        while at >= 0:
            found[at] = max(found.get(at, weight), weight)
            at = text.find(entry, at + 1)
    safe = []
    for phrase in lexicon.exceptions:
        at = text.find(f" {phrase} ")
        while at >= 0:
            safe.append((at, at + len(phrase) + 1))
            at = text.find(f" {phrase} ", at + 1)
    stay = {s: w for s, w in found.items() if not any(a <= s < b for a, b in safe)}
    return sum(stay.values()), len(stay)


def test_hits_inside_phrases_don_t_count():
    lexicon = Lexicon({" trash ": 2.0, " can ": 1.0, " tras": 1.5, " fish ": 4.0}, 1.0, 0.0, ("trash can", "can fish", "trash can fish trash"))
    for text in ("", " ", " trash ", " trash can ", " trash can fish ", " trash can fish trash can ", " can trash trash can can fish fish ", " trashy trash can trashy "):
        assert lexicon.total(text) == plain(lexicon, text), text


def test_many_phrases_take_linear_time():
    lexicon = Lexicon({" trash ": 2.0, " can ": 1.0}, 1.0, 0.0)
    began = time.perf_counter()
    assert lexicon.total(" " + "trash can and trash " * 60_000) == (2.0 * 60_000, 60_000)
    assert time.perf_counter() - began < 5

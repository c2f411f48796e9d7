"""Vectorised word hashing over many texts at once, and what is built on it: windows and minimisers.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and return.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.full(max(n, 64), _BASE, np.uint64)
        _POWERS[0] = 1
        _POWERS = np.cumprod(_POWERS, dtype=np.uint64)
    return _POWERS[:n]


@dataclass
class Words:
    hashes: np.ndarray  #: of each word, all texts in a row
    offsets: np.ndarray  #: text i has words offsets[i]:offsets[i + 1]
    starts: np.ndarray  #: first byte of each word in ``data``
    ends: np.ndarray
    data: np.ndarray  #: the bytes of all texts, each with a newline after it

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def hash_words(texts: list[bytes], between: np.ndarray = _SPACE) -> Words:
    """Words of the texts; ``between`` says which of 256 bytes stand between words, a newline among them."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = between[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.searchsorted(starts, at)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), offsets, starts, ends, data)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    total = np.add.reduceat(_TABLE[data[~space]] * _powers(int(size.max()))[place], first)
    return Words(mix(total + size.astype(np.uint64)), offsets, starts, ends, data)


def encode(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def gram_hashes(hashes: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each n consecutive values (across texts too: callers mask those)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    step, out = np.uint64(base), np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * step + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def inside(words: Words, n: int) -> np.ndarray:
    """Starts of n-word windows that lie in one text."""
    total = len(words.hashes)
    if total < n:
        return np.zeros(0, np.int64)
    docs = words.docs()
    return np.flatnonzero(docs[: total - n + 1] == docs[n - 1 :])


def minimisers(hashes: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each window of ``width`` words, where its smallest n-gram starts (the first of equal ones).

    The choice depends on the window's words only, so equal windows choose the same place in them.
    """
    grams = mix(gram_hashes(hashes, n) + np.uint64(0x5851F42D4C957F2D))
    span = width - n + 1
    if len(grams) < span:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 30) - 1)
    if len(grams) > int(low):
        raise ValueError("too many words in one slice")
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    held = 1
    while held * 2 <= span:
        least = np.minimum(least[: len(least) - held], least[held:])
        held *= 2
    if held < span:
        rest = span - held
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return (least & low).astype(np.int64)

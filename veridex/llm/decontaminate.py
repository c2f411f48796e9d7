"""Operator 9: benchmark decontamination by Wu-Manber search over words.

Patterns are the 13-word windows of benchmark items; an item of fewer words is one pattern. For each pattern length the
matcher has a shift table over two-word blocks (how far the window may move on, given the block at its end) and, for
blocks that end a pattern, a bucket of the patterns: one with the hash of the window is compared with it word by word. The
tables are sorted arrays, so a block of items takes a worker about ten times its text.

Edge cases: null and empty texts have no words and no hits; an item without words gives no pattern; items with equal
windows are all reported; items without an id count as one, which items_sha256 leaves out; a benchmark that exceeds a
block's size is searched block by block, and the hits are merged by row, so repeated rows and null doc_ids stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Shared, fresh, map_arrow, parts, stage, to_batch
from .textkit import Words, encode, gram_hashes, hash_words

WINDOW = 13
#: Bytes of benchmark text in one block of patterns: what a worker holds and what is broadcast at once.
BLOCK_BYTES = 16 << 20
#: Ends of windows that one lane of a search steps through; windows that are compared at once.
STEPS, CANDIDATES = 256, 1 << 16
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(texts: list[str | None]) -> Words:
    """ASCII-lower-cased words as hashes and bytes; bytes over 0x7F belong to words, so no character is cut."""
    return hash_words([t.lower() for t in encode(texts)], _BETWEEN)


def written(words: Words, start: int, n: int) -> bytes:
    """n words from ``start`` on, with a blank between them."""
    return b" ".join(words.data[a:e].tobytes() for a, e in zip(words.starts[start : start + n], words.ends[start : start + n]))


class Patterns:
    """All patterns of one length, as sorted arrays: some 40 bytes a window, and the words of the items once.

    ``keys`` are the two-word blocks of the patterns with their ``shift``: how far the end of a window may move on from
    there. Block k, where it ends patterns, has the bucket ``offset[k]:offset[k + 1]`` of them, by the hash of the whole.
    """

    def __init__(self, length: int, keys: np.ndarray, shift: np.ndarray, last: np.ndarray, whole: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.length, self.block = length, min(2, length)
        order = np.lexsort((shift, keys))
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        self.keys, self.shift = keys[order][first], shift[order][first]
        bucket = np.searchsorted(self.keys, last)
        order = np.lexsort((whole, bucket))
        self.offset = np.searchsorted(bucket[order], np.arange(len(self.keys) + 1))
        self.whole, self.item, self.begin, self.end = whole[order], item[order], begin[order], end[order]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.shift, self.offset, self.whole, self.item, self.begin, self.end))

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ends, blocks) of windows of the texts that end in a block with a bucket. All lanes of a batch step on together,
        each by the shift of its own block, so most windows are never looked at."""
        m, b = self.length, self.block
        n = np.diff(words.offsets)
        lanes = np.maximum(-(-(n - m + 1) // STEPS), 0)
        doc = np.repeat(np.arange(len(n)), lanes)
        own = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = words.offsets[doc] + m + STEPS * own
        stop = np.minimum(at + STEPS, words.offsets[doc + 1] + 1)
        blocks = gram_hashes(words.hashes, b)
        ends, found = [], []
        while len(at):
            key = blocks[at - b]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            step = np.where(self.keys[k] == key, self.shift[k], m - b + 1)
            on = step == 0
            ends.append(at[on])
            found.append(k[on])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, found))

    def find(self, words: Words, data: bytes, ids: list[int | None]) -> Iterator[tuple[int, set[int | None]]]:
        """(first word, items) of each occurrence in the texts."""
        all_ends, all_blocks = self.candidates(words)
        for cut in range(0, len(all_ends), CANDIDATES):
            start, block = all_ends[cut : cut + CANDIDATES] - self.length, all_blocks[cut : cut + CANDIDATES]
            target = gram_hashes(words.hashes[start[:, None] + np.arange(self.length)].ravel(), self.length)[:: self.length]
            low, high = self.offset[block], self.offset[block + 1]
            top = high.copy()
            while (low < high).any():  # the first pattern of the bucket whose hash isn't less
                middle = np.minimum((low + high) // 2, len(self.whole) - 1)
                open_, less = low < high, self.whole[middle] < target
                low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
            for i in np.flatnonzero((low < top) & (self.whole[np.minimum(low, len(self.whole) - 1)] == target)):
                text = written(words, start[i], self.length)
                items, k = set(), low[i]
                while k < top[i] and self.whole[k] == target[i]:
                    if data[self.begin[k] : self.end[k]] == text:
                        items.add(ids[self.item[k]])
                    k += 1
                if items:
                    yield int(start[i]), items


class Matcher:
    """The patterns of a block of items, by length, with the items' words once, blanks between them."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        texts: list[bytes] = []
        size = 0
        by_length: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for a, b in _runs([len(t or "") for _, t in items], SLICE_BYTES):
            words = words_of([t for _, t in items[a:b]])
            length = words.ends - words.starts
            # where each word stands in ``data``: items in a row, a blank after each word
            place = size + np.cumsum(length + 1) - (length + 1)
            texts.append(written(words, 0, len(words.hashes)) + b" " if len(words.hashes) else b"")
            size += len(texts[-1])
            n = np.diff(words.offsets)
            doc = words.docs()
            inner = np.arange(len(doc)) - words.offsets[doc]
            for m in np.unique(np.minimum(n, window)):
                if not m:
                    continue
                block = min(2, int(m))
                on = np.minimum(n, window) == m
                ends_block = np.flatnonzero(on[doc] & (inner + block <= n[doc]))
                shift = np.maximum(0, m - block - inner[ends_block])
                first = np.flatnonzero(on[doc] & (inner + m <= n[doc]))
                grams, wholes = gram_hashes(words.hashes, block), gram_hashes(words.hashes, int(m))
                by_length.setdefault(int(m), []).append((grams[ends_block], shift.astype(np.int8), grams[first + m - block], wholes[first], (a + doc[first]).astype(np.int32), place[first].astype(np.int32), (place + length)[first + m - 1].astype(np.int32)))
        self.data = b"".join(texts)
        self.engines = [Patterns(m, *map(np.concatenate, zip(*held))) for m, held in sorted(by_length.items())]

    def search(self, words: Words) -> tuple[list[list[int]], list[list[int | None]]]:
        """Per text its hit words as start, end, start, end ... in ascending order, and the items that occur, null last."""
        spans: list[list[tuple[int, int]]] = [[] for _ in words.offsets[1:]]
        items: list[set] = [set() for _ in spans]
        for engine in self.engines:
            for start, who in engine.find(words, self.data, self.ids):
                doc = int(np.searchsorted(words.offsets, start, side="right")) - 1
                at = start - int(words.offsets[doc])
                spans[doc].append((at, at + engine.length))
                items[doc] |= who
        return [merge(s) for s in spans], [sorted(i, key=lambda w: (w is None, w or 0)) for i in items]


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that add up to about ``limit``, one at least in each."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def merge(spans: Iterable[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The items with a text in blocks of bounded size, one block on the driver at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("i"), F.col("text").alias("t")).filter("t is not null")
    for row in rows.toLocalIterator():
        held.append((row.i, row.t))
        size += len(row.t.encode("utf-8", "surrogatepass"))
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


_COMPILED: dict[int, tuple[list, Matcher]] = {}


def _matcher(shared: Shared) -> Matcher:
    """The matcher of a broadcast block, built once in a worker; a worker holds one block at a time."""
    items = shared.value
    if id(items) not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[id(items)] = (items, Matcher(items))  # holding the items keeps their id from being used again
    return _COMPILED[id(items)][1]


_HITS = "doc_id bigint, n_words bigint, spans array<int>, items array<bigint>"
_HIT_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))]


def _scan(source: DataFrame, items: list[tuple[int | None, str]], all_rows: bool, row: str | None = None) -> DataFrame:
    """The hits of one block per row of (doc_id, text), and the column ``row`` if it is given; null stands last among the items."""
    shared = Shared(source.sparkSession, items)
    own = [] if row is None else [row]
    schema = pa.schema([(c, pa.int64()) for c in own] + _HIT_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in parts(batches):
            words = words_of(batch.column("text").to_pylist())
            spans, who = matcher.search(words)
            on = [i for i, s in enumerate(spans) if all_rows or s]
            kept = batch.take(pa.array(on, pa.int64()))
            yield to_batch({**{c: kept.column(c) for c in own}, "doc_id": kept.column("doc_id"), "n_words": np.diff(words.offsets)[on], "spans": [spans[i] for i in on], "items": [who[i] for i in on]}, schema)

    return map_arrow(source, run, "".join(f"`{c}` bigint, " for c in own) + _HITS)


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number for each row, staged so that every block sees the same ones."""
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def _merged(numbered: DataFrame, blocks: Iterator[list[tuple[int | None, str]]], row: str) -> DataFrame:
    """The number and the hits of all blocks for each row of numbered docs."""
    source = numbered.select(row, F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    merged = None
    for block in blocks:
        part = stage(_scan(source, block, merged is None, row), "hits")
        merged = part if merged is None else merged.unionByName(part)
    # spans of several blocks meet per row: at most as many as it has words
    grouped = merged.groupBy(row).agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    schema = pa.schema([(row, pa.int64()), *_HIT_FIELDS])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merge(zip(s[0::2], s[1::2])) for s in batch.column("spans").to_pylist()]
            yield to_batch({**{c: batch.column(c) for c in (row, "doc_id", "n_words", "items")}, "spans": spans}, schema)

    return map_arrow(grouped, join, f"`{row}` bigint, {_HITS}")


def hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans array<int> of hit words (start, end ...), items array<bigint>."""
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), first, True)
    return _merged(_numbered(docs.select("doc_id", "text"), "row"), chain([first, second], blocks), "row").drop("row")


def _contaminated(hit: int, n_words: int) -> bool:
    return hit > 0 and 20 * hit >= n_words


def report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (20 * n_hit >= n_words > 0 with a hit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_words").to_pylist()
            hit = [sum(s[1::2]) - sum(s[0::2]) for s in batch.column("spans").to_pylist()]
            items = batch.column("items").to_pylist()
            sha = [hashlib.sha256(",".join(sorted(str(k) for k in i if k is not None)).encode()).hexdigest() for i in items]
            bad = [_contaminated(h, w) for h, w in zip(hit, n)]
            yield to_batch({"doc_id": batch.column("doc_id"), "n_words": n, "n_hit": hit, "n_items": [len(i) for i in items], "items_sha256": sha, "contaminated": bad}, schema)

    found = hits(docs, benchmark, block_bytes)
    return map_arrow(found, run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def keep(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated ones; all columns of the others stay as they are."""
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:  # several blocks: a row's hits must meet first
        (row,) = fresh(docs, "row")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = [sum(s[1::2]) - sum(s[0::2]) for s in batch.column("spans").to_pylist()]
                bad = [_contaminated(h, w) for h, w in zip(hit, batch.column("n_words").to_pylist())]
                yield batch.select([row]).filter(pa.array(bad, pa.bool_()))

        numbered = _numbered(docs, row)
        gone = map_arrow(_merged(numbered, chain([first, second], blocks), row), choose, f"`{row}` bigint")
        return numbered.join(gone, row, "left_anti").select(docs.columns)
    shared = Shared(docs.sparkSession, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in parts(batches):
            words = words_of(batch.column(batch.schema.get_field_index("text")).to_pylist())
            spans, _ = matcher.search(words)
            good = [not _contaminated(sum(s[1::2]) - sum(s[0::2]), n) for s, n in zip(spans, np.diff(words.offsets))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_arrow(docs, run, docs.schema)

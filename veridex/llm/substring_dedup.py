"""Operator 8: repeated 35-word windows by a count-min prefilter and exact grouping.

Pass one counts the minimiser n-grams that stand for windows in a count-min sketch per partition. A window has one
minimiser at a fixed place in it, so it occurs at most as often as its minimiser is chosen, and a sketch never counts too
few: the merged sketch overestimates every window's count, and no repeated window is lost. Pass two takes only windows
whose estimate is two or more, and groups them exactly.

The sketch has cells in proportion to the keys, which are counted first, so it filters alike at every size. It is never
in one place: it stays in its segments, keys are dealt to them with the places they come from, and the places of repeated
ones return to the texts. Keys in cells of VERY_HOT occurrences, whose number is bounded by the keys over VERY_HOT, need no
asking and are not dealt out, so a frequent key makes no large segment.

Edge cases: null and empty texts have no windows; texts under 35 words lose nothing; repeated rows are copies of one
another; windows that overlap themselves count as often as they start; a null doc_id takes part in the counts; a table
without rows gives none; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketches
from .common import Shared, map_arrow, parts, release, stage, to_batch
from .repeats import CANDIDATE_SCHEMA, CANDIDATES, candidate_rows, digests, gram_keys, keyed, marked, placed_salts, removed, repeated_spans, runs, salts_for
from .textkit import encode, hash_words

WINDOW = 35
GRAM = 6
#: Estimated occurrences from which a gram's rows go the way for hot ones.
HOT = 200
#: Occurrences of a cell whose keys are taken for repeated without asking the sketch.
VERY_HOT = 1 << 20
#: Keys that are dealt to segments at once: many, so that a row has several.
DEALT = 1 << 18


def minimiser_keys(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The keys of all chosen minimisers, many to a row: what the sketch counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            words = hash_words(encode(part.column("text").to_pylist()))
            _, _, places = runs(words, window, gram)
            if len(places):
                yield to_batch({"keys": [gram_keys(words, places, gram).tobytes()]}, pa.schema([("keys", pa.binary())]))

    return map_arrow(docs.select("text"), run, "keys binary")


def _very_hot(sketch: DataFrame, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the cells of first rows with ``least`` occurrences or more, ascending, and their counts."""
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, counters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = sketches.decode_counts(np.frombuffer(counters, np.uint8)[:size])
                on = np.flatnonzero(n >= least)
                if len(on):
                    yield to_batch({"cell": s * size + on, "n": n[on]}, schema)

    found = sorted(map_arrow(sketch, pick, "cell bigint, n bigint").collect())  # keys over VERY_HOT at most
    return np.array([r.cell for r in found], np.int64), np.array([r.n for r in found], np.int64)


def _candidates(docs: DataFrame, sketch: DataFrame, width: int, window: int, gram: int, hot: int, very_hot: int) -> tuple[DataFrame, DataFrame]:
    """CANDIDATES whose estimate is two or more, and the staged table that they are read from."""
    size = min(sketches.SEGMENT, width)
    segments = width // size
    known = Shared(docs.sparkSession, _very_hot(sketch, size, very_hot))
    ask = pa.schema([("segment", pa.int32()), ("counters", pa.binary()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("n", pa.binary())])
    ask_type = "segment int, counters binary, keys binary, docs binary, places binary, n binary"

    found_schema = pa.schema([("doc_key", pa.int64()), ("place", pa.int32()), ("gram", pa.int64()), ("salts", pa.int32())])

    def by_segment(keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        """A row for each segment: its keys with their documents and places; very hot ones have their counts already."""
        hot_cells, hot_counts = known.value
        segment = sketches.segment_of(keys, segments)
        n = np.zeros(len(keys), np.int64)
        if len(hot_cells):
            cell = segment * size + sketches.cells(keys, 0, size)
            k = np.minimum(np.searchsorted(hot_cells, cell), len(hot_cells) - 1)
            n = np.where(hot_cells[k] == cell, hot_counts[k], 0)
        segment = np.where(n > 0, -1, segment)  # these stay together
        order = np.argsort(segment, kind="stable")
        cut = np.append(np.flatnonzero(np.concatenate([[True], np.diff(segment[order]) != 0])), len(order))
        rows: dict[str, list] = {f.name: [] for f in ask}
        for a, b in zip(cut, cut[1:]):
            on = order[a:b]
            rows["segment"].append(segment[on[0]])
            rows["counters"].append(None)
            for name, values in (("keys", keys), ("docs", docs.astype("<i8")), ("places", places.astype("<i4")), ("n", n.astype("<i8"))):
                rows[name].append(values[on].tobytes() if name != "n" or n[on[0]] else None)
        return to_batch(rows, ask)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        many = 0
        for part in parts(batches):
            words = hash_words(encode(part.column("text").to_pylist()))
            _, _, places = runs(words, window, gram)
            if len(places):
                doc = np.searchsorted(words.offsets, places, side="right") - 1
                held.append((gram_keys(words, places, gram), part.column("doc_key").to_numpy()[doc], places - words.offsets[doc]))
                many += len(places)
            if many > DEALT:
                yield by_segment(*map(np.concatenate, zip(*held)))
                held, many = [], 0
        if held:
            yield by_segment(*map(np.concatenate, zip(*held)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counters come before the keys of their segment."""
        counters = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["counters"] is not None:
                    counters = np.frombuffer(row["counters"], np.uint8).reshape(1, sketches.DEPTH, size)
                    continue
                keys = np.frombuffer(row["keys"], np.uint64)
                most = np.frombuffer(row["n"], "<i8") if row["n"] else sketches.estimate(counters, keys)
                on = np.flatnonzero(most >= 2)
                if len(on):
                    yield to_batch({"doc_key": np.frombuffer(row["docs"], "<i8")[on], "place": np.frombuffer(row["places"], "<i4")[on], "gram": keys[on].view(np.int64), "salts": salts_for(most[on], hot)}, found_schema)

    dealt = map_arrow(keyed(docs), deal, ask_type)
    held = sketch.select("segment", "counters", *[F.lit(None).cast("binary").alias(c) for c in ("keys", "docs", "places", "n")])
    # very hot keys (segment -1) are answered anywhere
    lane = F.when(F.col("segment") < 0, F.xxhash64("docs")).otherwise(F.col("segment").cast("bigint"))
    met = dealt.unionByName(held).repartition(lane).sortWithinPartitions("segment", F.asc_nulls_last("counters"))
    found = stage(map_arrow(met, answer, "doc_key bigint, place int, gram bigint, salts int"), "repeated-keys")
    near = keyed(docs).join(marked(found), "doc_key").select("doc_key", "doc_id", "text", "places")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            words = hash_words(encode(part.column("text").to_pylist()))
            first, count, at = runs(words, window, gram)
            if len(first):
                salts = placed_salts(words, at, part.column("places").to_pylist(), gram)
                on = np.flatnonzero(salts >= 0)
                if len(on):
                    yield to_batch(candidate_rows(words, part.column("doc_key"), part.column("doc_id"), window, first[on], count[on], gram_keys(words, at[on], gram), salts[on]), CANDIDATE_SCHEMA)

    return map_arrow(near, choose, CANDIDATES), found


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int | None = None, hot: int = HOT, keep_first: bool = False, very_hot: int = VERY_HOT) -> DataFrame:
    """(doc_key, a, b) of words in repeated windows. ``width``, the cells of the sketch, follows from the keys if not given."""
    keys = stage(minimiser_keys(docs, window, gram), "keys")
    width = width or sketches.cells_for(sketches.key_count(keys))
    sketch = stage(sketches.count_segments(keys, width), "sketch")
    release(keys)
    candidates, found = _candidates(docs, sketch, width, window, gram, hot, very_hot)
    out = repeated_spans(candidates, window, keep_first)  # stages the candidates
    release(sketch, found)
    return out


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return digests(docs, spans(docs, **options))


def remove(docs: DataFrame, **options) -> DataFrame:
    """docs without the words of repeated windows."""
    return removed(docs, spans(docs, **options))

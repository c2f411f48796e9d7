"""A count-min sketch of 64-bit keys, in segments that are counted apart and merged.

A key belongs to one segment, by its high bits, and has a cell in each row of that segment, so that a segment can be built
and asked without the others. Counters are added up in full and kept in one byte: exact to EXACT, then rounded up on a
logarithmic scale, so an estimate is never too low.

Edge cases: null and empty key strings count nothing; without keys every estimate is 0; a key that repeats counts each
time; a key of any number of occurrences has one cell in a row, whose count is added up before and after the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, to_batch

#: Rows of a sketch; cells that a row of a segment has at most; the least number of cells.
DEPTH, SEGMENT, LEAST = 2, 1 << 17, 1 << 12
#: Cells for each key: a key that occurs once is then taken for a repeated one with a probability under 0.16.
CELLS = 2
#: Keys that a partition holds before it passes their counts on.
FLUSH = 2_000_000
#: Counts up to here are exact; steps in a doubling beyond.
EXACT, STEPS = 200, 4


def cells_for(keys: int) -> int:
    """Cells of a row for so many keys, a power of two."""
    return max(LEAST, 1 << (CELLS * keys - 1).bit_length())


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def cells(keys: np.ndarray, row: int, size: int) -> np.ndarray:
    return ((keys >> np.uint64(20 * row)) & np.uint64(size - 1)).astype(np.int64)


def encode_counts(n: np.ndarray) -> np.ndarray:
    over = np.ceil(STEPS * np.log2(np.maximum(n, EXACT) / EXACT))
    return np.where(n <= EXACT, n, np.minimum(255, EXACT + over)).astype(np.uint8)


def decode_counts(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    return np.where(code <= EXACT, code, np.ceil(EXACT * 2.0 ** ((code - EXACT) / STEPS))).astype(np.int64)


def estimate(counters: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts that are never too low, from counters of shape (segments, DEPTH, cells)."""
    segment, size = segment_of(keys, counters.shape[0]), counters.shape[2]
    return decode_counts(np.minimum(*[counters[segment, row, cells(keys, row, size)] for row in range(DEPTH)]))


def count_segments(keys: DataFrame, width: int) -> DataFrame:
    """(segment, counters) of a table with one binary column of 64-bit keys; ``width`` cells in all, a power of two."""
    size = min(SEGMENT, width)
    segments = width // size
    schema = pa.schema([("segment", pa.int32()), ("cell", pa.binary()), ("n", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        many = 0

        def flush() -> pa.RecordBatch:
            own = np.frombuffer(b"".join(held), np.uint64)
            segment = segment_of(own, segments)
            rows: dict[str, list] = {"segment": [], "cell": [], "n": []}
            # cells of all rows of a segment are numbered on
            place, n = np.unique(np.concatenate([(segment * DEPTH + row) * size + cells(own, row, size) for row in range(DEPTH)]), return_counts=True)
            at = np.searchsorted(place, np.arange(segments + 1) * (DEPTH * size))
            for s in np.flatnonzero(np.diff(at)):
                rows["segment"].append(s)
                rows["cell"].append((place[at[s] : at[s + 1]] - s * DEPTH * size).astype("<u4").tobytes())
                rows["n"].append(n[at[s] : at[s + 1]].astype("<u4").tobytes())
            return to_batch(rows, schema)

        for batch in batches:
            for own in batch.column(0).to_pylist():
                if own:
                    held.append(own)
                    many += len(own) >> 3
                if many > FLUSH:
                    yield flush()
                    held, many = [], 0
        yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment: one segment is held at a time."""
        now, total = -1, np.zeros(0, np.int64)
        out = pa.schema([("segment", pa.int32()), ("counters", pa.binary())])
        for batch in batches:
            for s, cell, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now >= 0:
                        yield to_batch({"segment": [now], "counters": [encode_counts(total).tobytes()]}, out)
                    now, total = s, np.zeros(DEPTH * size, np.int64)
                total[np.frombuffer(cell, "<u4")] += np.frombuffer(n, "<u4")
        if now >= 0:
            yield to_batch({"segment": [now], "counters": [encode_counts(total).tobytes()]}, out)

    counted = map_arrow(keys, count, "segment int, cell binary, n binary").repartition("segment").sortWithinPartitions("segment")
    return map_arrow(counted, merge, "segment int, counters binary")


def key_count(keys: DataFrame) -> int:
    return keys.agg(F.sum(F.length(keys.columns[0]) / 8).cast("bigint").alias("n")).first().n or 0


def count_min(keys: DataFrame, width: int) -> np.ndarray:
    """The whole sketch on the driver, of shape (segments, DEPTH, cells): for a width that the caller bounds."""
    size = min(SEGMENT, width)
    out = np.zeros((width // size, DEPTH, size), np.uint8)
    for row in count_segments(keys, width).toLocalIterator():
        out[row.segment] = np.frombuffer(row.counters, np.uint8).reshape(DEPTH, size)
    return out

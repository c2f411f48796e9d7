"""Operator 10: repeated passages by a sparse suffix array.

1. Suffixes are kept only where a minimiser of a 50-word window starts, about one in 22 words: equal windows keep equal
   ones, since the choice depends on the words alone.
2. The kept suffixes are sorted over the whole corpus by their first 8 words (as a hash; the keys end in document and
   place, so that a frequent suffix spreads over many tasks). Suffixes whose neighbours differ are left behind.
3. The others get their words, as far as the windows of their minimiser reach: to the right, and to the left of the
   suffix. Within equal first words they are sorted to the end, once by the words to the right and once by those to the
   left, and neighbours are compared in both orders (``matches``): the lengths they share give, for each number of words
   to the left, which suffixes are equal that far left and as far right as a window needs. Such windows are repeated, and
   neighbouring ones join to passages of any length.
4. Suffixes that occur HOT times or more may stand in a third of all rows, too many for one task. Their windows are compared by
   partial aggregation instead (repeats.frequent_spans), which gives the same windows.

Words are compared by 64-bit hashes of their bytes.

Edge cases: texts under 50 words, null and empty texts have no suffixes; repeated rows are copies of one another; a
passage that repeats in one document counts; a null doc_id takes part but is not cut; with keep_first the occurrence of
least (doc_id, place) stays, in all rows that repeat it; a table without rows gives none; texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, parts, release, stage, to_batch
from .repeats import SALTED, SPANS, cut_keys, digests, frequent_spans, gram_keys, keyed, marked, placed_salts, removed, runs, span_rows, whole_grams, window_keys
from .textkit import encode, hash_words

#: Words of the shortest passage; first words that suffixes are sorted by.
LENGTH = 50
GRAM = 8
#: Occurrences from which a suffix goes the way for hot ones.
HOT = 200
#: Suffixes that are sorted at once, and rows of a run that are held while it goes on.
BLOCK, HELD = 4_096, 100_000


def suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(gram, doc_key, place) of the kept suffixes; gram is the hash of the suffix's first words, place a word index."""
    schema = pa.schema([("gram", pa.int64()), ("doc_key", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            words = hash_words(encode(part.column("text").to_pylist()))
            _, _, places = runs(words, length, gram)
            if len(places):
                doc = np.searchsorted(words.offsets, places, side="right") - 1
                yield to_batch({"gram": gram_keys(words, places, gram).view(np.int64), "doc_key": part.column("doc_key").take(pa.array(doc)), "place": places - words.offsets[doc]}, schema)

    return map_arrow(keyed(docs), run, "gram bigint, doc_key bigint, place int")


def neighbours(kept: DataFrame, held_rows: int = HELD) -> DataFrame:
    """Sorted suffixes with ``same``, how many equal ones lie in the partition, and ``edge``, if these touch its border."""
    out_schema = pa.schema([("gram", pa.int64()), ("doc_key", pa.int64()), ("place", pa.int32()), ("same", pa.int32()), ("edge", pa.bool_())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only suffixes with an equal neighbour, or at the border, go on. A long run is passed on in pieces, so it isn't held."""
        held: pa.Table | None = None
        first = True
        seen = 0  # rows of the held run that were passed on already

        def emit(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first
            gram = table.column("gram").to_numpy()
            start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            size = np.diff(np.append(start, len(gram)))
            same = np.repeat(size, size)
            same[: size[0]] += seen
            edge = np.zeros(len(gram), bool)
            if first:
                edge[: size[0]] = True
            if last:
                edge[start[-1] :] = True
            if len(start) > 1:
                first = False
            on = np.flatnonzero((same > 1) | edge)
            if len(on):
                t = table.take(pa.array(on)).combine_chunks()
                yield to_batch({**{c: t.column(c).combine_chunks() for c in ("gram", "doc_key", "place")}, "same": same[on], "edge": edge[on]}, out_schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield from emit(table.slice(0, cut), False)
                first, seen = False, 0
                table = table.slice(cut)
            if table.num_rows > held_rows:  # one row stays to tell the run's end
                yield from emit(table.slice(0, table.num_rows - 1), False)
                seen += table.num_rows - 1
                table = table.slice(table.num_rows - 1)
            held = table
        if held is not None:
            yield from emit(held, True)

    # rows that repeat a text are told apart by a number, so they don't meet in one partition
    numbered = kept.withColumn("number", F.monotonically_increasing_id())
    order = ("gram", "doc_key", "place", "number")
    ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("number")
    return map_arrow(ranged, compare, "gram bigint, doc_key bigint, place int, same int, edge boolean")


def marked_places(sorted_: DataFrame, hot: int) -> DataFrame:
    """(doc_key, places): where a document's suffixes have equals, with the parts that hot ones are dealt into.

    The number of parts follows from the equals in a suffix's own partition; only the few rows at a partition's border that are
    not hot there are joined with what lies next door, so no frequent suffix is a join's key.
    """
    salts = lambda n: F.when(n >= hot, F.ceil(n / SALTED)).otherwise(0).cast("int").alias("salts")
    known = sorted_.filter(f"same >= {hot} or not edge").select("doc_key", "place", "gram", salts(F.col("same")))
    next_door = sorted_.filter("edge").groupBy("gram").agg(F.count("*").alias("n"), F.max("same").alias("most"))
    border = sorted_.filter(f"same < {hot} and edge").join(next_door, "gram").filter("same > 1 or n > 1").select("doc_key", "place", "gram", salts(F.col("most")))
    return marked(known.unionByName(border))


def class_numbers(order: np.ndarray, gram: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the runs of rows whose neighbours in ``order`` share ``least`` words or more, and the gram."""
    new = (shared < least) | (gram[order][1:] != gram[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(new)])
    return out


def sorted_neighbours(gram: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of gram and words, and how many first words each shares with the next."""
    key = np.ascontiguousarray(np.column_stack([gram, words]).astype(">u8"))
    order = np.argsort(key.view(f"S{key.shape[1] * 8}").ravel(), kind="stable")
    differ = words[order][1:] != words[order][:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return order, shared


def matches(gram: np.ndarray, lead: np.ndarray, tail: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words to the left, rows, classes) of repeated windows.

    Row i is a suffix with ``lead[i]`` known words before it, the nearest first in ``left[i]``, and ``tail[i]`` from it on in
    ``right[i]``. A window of o words to the left and length - o to the right is in the class of another if the two suffixes lie in
    one run of the left order that shares o words, and in one run of the right order that shares length - o.
    """
    m = len(gram)
    if m < 2:
        return
    by_right, shared_right = sorted_neighbours(gram, right)
    by_left, shared_left = sorted_neighbours(gram, left)

    def reach(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The most words that a row shares with any other, a neighbour then."""
        out = np.empty(m, np.int64)
        same = np.where(gram[order][1:] == gram[order][:-1], shared, 0)
        out[order] = np.maximum(np.append(same, 0), np.insert(same, 0, 0))
        return out

    most_right, most_left = np.minimum(tail, reach(by_right, shared_right)), np.minimum(lead, reach(by_left, shared_left))
    for o in range(left.shape[1] + 1):
        on = np.flatnonzero((most_left >= o) & (most_right >= length - o))
        if len(on) < 2:
            continue
        classes = class_numbers(by_right, gram, shared_right, length - o)[on] * m + class_numbers(by_left, gram, shared_left, o)[on]
        order = np.argsort(classes, kind="stable")
        same = classes[order][1:] == classes[order][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if twice.any():
            yield o, on[order[twice]], classes[order[twice]]


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, hot: int | None = None) -> DataFrame:
    """(doc_key, a, b) of words in passages of ``length`` words or more that occur more than once."""
    kept = stage(suffixes(docs, length, gram), "suffixes")
    sorted_ = stage(neighbours(kept), "neighbours")
    release(kept)
    places = stage(marked_places(sorted_, HOT if hot is None else hot), "places")  # their aggregation isn't in the tasks that hold the texts
    near = keyed(docs).join(places, "doc_key").select("doc_key", "doc_id", "text", "places")
    schema = pa.schema([("doc_key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("gram", pa.int64()), ("salts", pa.int32()), ("lead", pa.int32()), ("body", pa.binary())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each marked suffix with the bytes of its words, ``lead`` words to its left first; a hot one with keys of its windows."""
        for part in parts(batches):
            words = hash_words(encode(part.column("text").to_pylist()))
            first, count, at = runs(words, length, gram)
            if not len(first):
                continue
            salts = placed_salts(words, at, part.column("places").to_pylist(), gram)
            on = np.flatnonzero(salts >= 0)
            if not len(on):
                continue
            first, count, at, salts = first[on], count[on], at[on], salts[on]
            doc = np.searchsorted(words.offsets, at, side="right") - 1
            value, data = window_keys(words, length), words.data
            end = words.ends[first + count + length - 2]
            body = [value[a : a + n].tobytes() if s else data[b:e].tobytes() for a, n, s, b, e in zip(first, count, salts, words.starts[first], end)]
            yield to_batch({"doc_key": part.column("doc_key").take(pa.array(doc)), "doc_id": part.column("doc_id").take(pa.array(doc)), "start": first - words.offsets[doc], "gram": gram_keys(words, at, gram).view(np.int64), "salts": salts, "lead": at - first, "body": body}, schema)

    found = stage(map_arrow(near, extend, "doc_key bigint, doc_id bigint, start int, gram bigint, salts int, lead int, body binary"), "repeated-suffixes")
    release(sorted_, places)
    side = length - gram

    def solve(table: pa.Table) -> pa.RecordBatch:
        words = hash_words(table.column("body").to_pylist())
        lead, doc = table.column("lead").to_numpy().astype(np.int64), table.column("doc_id").fill_null(-(2**63)).to_numpy()
        place = table.column("start").to_numpy().astype(np.int64) + lead
        begin, n = words.offsets[:-1], np.diff(words.offsets)
        tail = n - lead
        hashes = np.append(words.hashes, np.uint64(0))
        to_right, to_left = np.arange(length), np.arange(side)
        right = hashes[np.where(to_right < tail[:, None], (begin + lead)[:, None] + to_right, len(words.hashes))]
        left = hashes[np.where(to_left < lead[:, None], (begin + lead)[:, None] - 1 - to_left, len(words.hashes))]
        rows, ats = [], []
        for o, row, classes in matches(table.column("gram").to_numpy().view(np.uint64), lead, tail, left, right, length):
            at = place[row] - o
            if keep_first:
                order = np.lexsort((at, doc[row], classes))
                row, at, classes = row[order], at[order], classes[order]
                new = np.concatenate([[True], classes[1:] != classes[:-1]])
                least = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
                later = (doc[row] != doc[row[least]]) | (at != at[least])  # a row that repeats doc_id and place is the first too
                row, at = row[later], at[later]
            rows.append(row)
            ats.append(at)
        row, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, ats))
        order = np.lexsort((at, row))
        return span_rows(cut_keys(table.column("doc_key"), table.column("doc_id")), row[order], at[order], length)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_grams(batches, BLOCK):
            yield solve(table)

    usual = map_arrow(found.filter("salts = 0").repartition("gram").sortWithinPartitions("gram"), compare, SPANS)
    frequent = found.filter("salts > 0").select("doc_key", "doc_id", "start", "gram", "salts", F.col("body").alias("windows"))
    return usual.unionByName(frequent_spans(frequent, length, keep_first))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed (words in repeated passages, every occurrence), kept_sha256."""
    return digests(docs, spans(docs, **options))


def remove(docs: DataFrame, **options) -> DataFrame:
    """docs without repeated passages; with keep_first=True the first occurrence of each stays."""
    return removed(docs, spans(docs, **options))
